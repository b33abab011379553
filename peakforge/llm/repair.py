"""Repair of the structure of conversations at the least cost, by a persistent dynamic program over edit prefixes.

A conversation is well formed when its role initials read ``(s?(ua)+)?``. Rows may be kept (0), given another role (2) or
deleted (3), and empty rows inserted (2); blank rows and repetitions must go, and a truncated row that stays adds 1. The
cheapest edits are found by a pass over four states (nothing yet, system, user, assistant). The best edit string of each
state is a node of a tree of prefixes: a node holds its last edit, its depth, a rolling hash of its whole string and
its ancestors 1, 2, 4 ... edits above, so strings share what they have in common and a step adds a constant number of nodes. Ties of cost are
compared by a search for the longest common prefix down the ancestors' hashes; prefixes of equal hash that are not the
same node are spelled out before they count as equal. Strings of equal cost in one state are never prefixes of one
another (an edit string fixes its state, and what one has more would be insertions, which cost), so the least of them stays the least whatever follows.

Spark damages, deals out and sorts the rows by conversation; tasks read them as a stream. A conversation of more than ``most_rows`` rows or ``most_chars``
characters is not buffered: repetitions are then found by a grouping over all tasks, the program runs over codes of one letter, giving out the
part of the edit string that all states share, and a second pass over the sorted rows hashes the repaired text as it goes by.

Defined cases: null roles and texts are one space, and so are null ids and turns in the hash that picks the damage; a null conversation id is a conversation of
its own; rows that tie in turn stand by role, then text; repeated rows are repetitions of the first; a conversation that
loses all its rows gives zeros and the hash of the empty text; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.llm.common import written

SPACE, STOPS = " \t\n\x0b\x0c\r", ".!?"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: state after a row of this initial, from the states in which it may follow
FOLLOWS = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLES = {"u": "user", "a": "assistant"}
GONE = "#"  # code of a row that must be deleted
SORTED = ["conv_id", "turn", "role", "text"]
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Prefixes:
    """Edit strings as nodes of a tree: node 0 is the empty string."""

    PRIME, BASE = (1 << 61) - 1, 911_382_323

    def __init__(self) -> None:
        self.last, self.depth, self.hash, self.up = [""], [0], [0], [[]]

    def add(self, node: int, edit: str) -> int:
        """The node of ``node``'s string with ``edit`` after it; its ancestors are 1, 2, 4 ... edits above."""
        above = [node]
        while len(self.up[above[-1]]) >= len(above):
            above.append(self.up[above[-1]][len(above) - 1])
        self.last.append(edit)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.BASE + ord(edit)) % self.PRIME)
        self.up.append(above)
        return len(self.last) - 1

    def ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.up[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def spelled(self, node: int, down_to: int = 0) -> str:
        """The edits from below depth ``down_to`` to ``node``."""
        found = []
        while self.depth[node] > down_to:
            found.append(self.last[node])
            node = self.up[node][0]
        return "".join(reversed(found))

    def same(self, a: int, b: int) -> bool:
        """Whether two nodes of equal depth and hash hold the same string, by their edits."""
        while a != b:
            if self.last[a] != self.last[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the string of ``a`` comes before that of ``b`` in ASCII order."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if x == y or (self.hash[x] == self.hash[y] and self.same(x, y)):
            return self.depth[a] < self.depth[b]
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        above = self.up[x][0], self.up[y][0]
        if self.last[x] == self.last[y] or not self.same(*above):  # two strings had one hash
            return self.spelled(a) < self.spelled(b)
        return self.last[x] < self.last[y]

    def shared(self, nodes: Iterable[int]) -> int:
        """The deepest node that is above, or is, every one of ``nodes``."""
        low, *others = nodes
        for n in others:
            depth = min(self.depth[low], self.depth[n])
            low, n = self.ancestor(low, depth), self.ancestor(n, depth)
            for k in range(len(self.up[low]) - 1, -1, -1):
                if k < len(self.up[low]) and self.up[low][k] != self.up[n][k]:
                    low, n = self.up[low][k], self.up[n][k]
            if low != n:
                low = self.up[low][0]
        return low


class Audit:
    """The cheapest edits of a conversation, row by row: feed codes, then ask for the result."""

    def __init__(self, block: int = 4096) -> None:
        self.tree, self.best, self.told, self.fed, self.block = Prefixes(), {NOTHING: (0, 0)}, [], 0, block
        self.insert()

    def offer(self, best: dict[int, tuple[int, int]], state: int, cost: int, node: int, edit: str) -> None:
        have = best.get(state)
        if have is None or cost <= have[0]:
            made = self.tree.add(node, edit)
            if have is None or cost < have[0] or self.tree.less(made, have[1]):
                best[state] = cost, made

    def insert(self) -> None:
        for initial in "ua":
            for state, after in FOLLOWS[initial].items():
                if state in self.best:
                    cost, node = self.best[state]
                    self.offer(self.best, after, cost + INSERT, node, "I")

    def feed(self, code: str) -> None:
        """One row: its initial (any letter outside s, u, a has to change), in capitals if truncated, or GONE."""
        made: dict[int, tuple[int, int]] = {}
        extra = TRUNCATED * code.isupper()
        for state, (cost, node) in self.best.items():
            self.offer(made, state, cost + DELETE, node, "D")
            if code != GONE:
                after = FOLLOWS.get(code.lower(), {}).get(state)
                if after is not None:
                    self.offer(made, after, cost + KEEP + extra, node, "K")
                for initial in "ua":
                    after = FOLLOWS[initial].get(state)
                    if after is not None:
                        self.offer(made, after, cost + REROLE + extra, node, "R")
        self.best = made
        self.insert()
        self.fed += 1
        if self.fed % self.block == 0:
            self.cut()

    def cut(self) -> None:
        """Give out the edits that the strings of all states share, and keep a tree of the rest alone."""
        root = self.tree.shared([n for _, n in self.best.values()])
        self.told.append(self.tree.spelled(root))
        old, self.tree, made = self.tree, Prefixes(), {}
        for state, (cost, node) in self.best.items():
            at, path = 0, ""
            for edit in old.spelled(node, old.depth[root]):
                path += edit
                at = made[path] if path in made else made.setdefault(path, self.tree.add(at, edit))
            self.best[state] = cost, at

    def result(self) -> tuple[int, str]:
        """(cost, edits) of the cheapest well-formed conversation."""
        ends = [self.best[s] for s in (NOTHING, ASSISTANT) if s in self.best]
        least = min(cost for cost, _ in ends)
        found = None
        for cost, node in ends:
            if cost == least and (found is None or self.tree.less(node, found)):
                found = node
        return least, "".join(self.told) + self.tree.spelled(found)


@lru_cache(maxsize=50_000)
def cheapest(codes: str) -> tuple[int, str]:
    """(cost, edits) for the codes of a conversation's rows; conversations of the same codes share their answer."""
    audit = Audit()
    for code in codes:
        audit.feed(code)
    return audit.result()


def fault_of(text: str) -> str:
    """blank, truncated or nothing."""
    told = text.rstrip(SPACE)
    return "blank" if not told else "" if told[-1] in STOPS else "truncated"


def code_of(role: str, fault: str) -> str:
    if fault in ("blank", "duplicate"):
        return GONE
    initial = role[:1] if role[:1] in FOLLOWS else "x"
    return initial.upper() if fault == "truncated" else initial


class Repaired:
    """The repaired conversation, written into a hash: edits in order, each row when its edit is reached."""

    def __init__(self, edits: str) -> None:
        self.edits, self.at, self.state, self.hash, self.any = edits, 0, NOTHING, hashlib.sha256(), False

    def put(self, role: str, text: str, initial: str) -> None:
        self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any, self.state = True, FOLLOWS[initial][self.state]

    def wanted(self) -> str:
        return "a" if self.state == USER else "u"

    def inserts(self) -> None:
        while self.edits[self.at : self.at + 1] == "I":
            self.put(ROLES[self.wanted()], "", self.wanted())
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self.put(role, text, role[:1])
        elif edit == "R":
            self.put(ROLES[self.wanted()], text, self.wanted())

    def digest(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


class Facts:
    """Counts over a conversation's rows in order."""

    def __init__(self) -> None:
        self.turns, self.first, self.turn, self.before = 0, None, None, None
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = 0

    def row(self, turn: int | None, role: str, fault: str) -> None:
        if turn is not None:
            self.turns += turn != self.turn
            self.first, self.turn = turn if self.first is None else self.first, turn
        if fault:
            self.counts[fault] += 1
        self.illegal += self.before is not None and self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]

    def gaps(self) -> int:
        return 0 if self.first is None else self.turn - self.first + 1 - self.turns


def repaired(rows: list[tuple[int | None, str, str]]) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, edits, hash) for the (turn, role, text) of a conversation in order."""
    seen, facts, codes = set(), Facts(), []
    for turn, role, text in rows:
        fault = fault_of(text)
        if fault != "blank" and (role, text) in seen:
            fault = "duplicate"
        seen.add((role, text))
        facts.row(turn, role, fault)
        codes.append(code_of(role, fault))
    cost, edits = cheapest("".join(codes))
    out = Repaired(edits)
    for _, role, text in rows:
        out.row(role, text)
    return facts.gaps(), *facts.counts.values(), facts.illegal, cost, edits, out.digest()


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the damage that a hash of id and turn picks; dropped rows have no copy and no text."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("fault"),
    )
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).when(F.col("fault") > 0, F.col("text"))
    role = F.when(F.col("fault") == 4, "user").when(F.col("fault") > 0, F.col("role"))
    copies = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def told(rows: list[tuple], names: list[str], kinds: str) -> Iterator[pa.RecordBatch]:
    if rows:
        of = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        types = [of[k.split()[1]] for k in kinds.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def names_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def in_buffers(rows: DataFrame, most_rows: int, most_chars: int) -> DataFrame:
    """RESULT and ``long``: true, with nothing else than the id, for conversations beyond the buffer."""
    schema = f"{RESULT}, long boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        none, now, kept, chars, over = object(), None, [], 0, False
        now = none
        for conv, turn, role, text, copies in streamed(batches):
            if conv != now or now is none:
                if now is not none:
                    out.append((now, *([None] * 8), True) if over else (now, *repaired(kept), False))
                    if len(out) >= 2000:
                        yield from told(out, names_of(schema), schema)
                        out = []
                now, kept, chars, over = conv, [], 0, False
            if not over and copies:
                kept.extend([(turn, role, text)] * copies)
                chars += len(text) + len(role)
                if len(kept) > most_rows or chars > most_chars:
                    over, kept = True, []
        if now is not none:
            out.append((now, *([None] * 8), True) if over else (now, *repaired(kept), False))
        yield from told(out, names_of(schema), schema)

    return rows.repartition("conv_id").sortWithinPartitions(*SORTED).mapInArrow(run, schema)


def in_passes(rows: DataFrame) -> DataFrame:
    """RESULT for conversations of any length: no task holds more of one than its edit string and an Arrow batch."""
    rows = rows.where("copies > 0")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    mark = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    rows = rows.withColumns({"mark": mark, "place": place})
    first = rows.groupBy("conv_id", "mark").agg(F.min("place").alias("first")).alias("f")
    told_ = F.rtrim("text", F.lit(SPACE))
    fault = F.when(told_ == "", "blank").when(F.col("place") != F.col("first"), "duplicate").when(~F.substring(told_, -1, 1).isin(*STOPS), "truncated").otherwise("")
    both = rows.alias("r").join(first, F.col("r.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("r.mark") == F.col("f.mark")))
    coded = both.select("r.conv_id", "r.turn", "r.role", "r.text", "r.mark", "r.copies", fault.alias("fault"))
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"

    def pass_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = now = object()
        for conv, turn, role, mark_, copies, fault_ in streamed(batches):
            if conv != now or now is none:
                if now is not none:
                    cost, edits = audit.result()
                    yield from told([(now, facts.gaps(), *facts.counts.values(), facts.illegal, cost, edits)], names_of(schema), schema)
                now, facts, audit, before = conv, Facts(), Audit(), None
            for _ in range(copies):
                f = "duplicate" if fault_ != "blank" and before == (turn, mark_) else fault_
                before = turn, mark_
                facts.row(turn, role, f)
                audit.feed(code_of(role, f))
        if now is not none:
            cost, edits = audit.result()
            yield from told([(now, facts.gaps(), *facts.counts.values(), facts.illegal, cost, edits)], names_of(schema), schema)

    def pass_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = now = object()
        for conv, edits, role, text, copies in streamed(batches):
            if edits is not None:
                if now is not none:
                    yield from told([(now, out.digest())], ["conv_id", "repaired_sha256"], "conv_id long, repaired_sha256 string")
                now, out = conv, Repaired(edits)
                continue
            for _ in range(copies):
                out.row(role, text)
        if now is not none:
            yield from told([(now, out.digest())], ["conv_id", "repaired_sha256"], "conv_id long, repaired_sha256 string")

    # Codes stand in the order of the texts, which are dropped after the sort.
    order = coded.repartition("conv_id").sortWithinPartitions(*SORTED).select("conv_id", "turn", "role", "mark", "copies", "fault")
    audits = written(order.mapInArrow(pass_one, schema), "repair-audits")
    lines = audits.select("conv_id", "audit", *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("copies", "int"))))
    lines = lines.unionByName(rows.select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "copies"))
    lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "text").select("conv_id", "audit", "role", "text", "copies")
    hashed = lines.mapInArrow(pass_two, "conv_id long, repaired_sha256 string").alias("h")
    return audits.alias("a").join(hashed, F.col("a.conv_id").eqNullSafe(F.col("h.conv_id"))).select("a.*", "h.repaired_sha256")


def repair(conversations: DataFrame, *, most_rows: int = 4000, most_chars: int = 8_000_000) -> DataFrame:
    """RESULT for every conversation id of ``conversations``."""
    rows = damaged(conversations)
    found = written(in_buffers(rows, most_rows, most_chars), "repair-short")
    short = found.where("not long").drop("long")
    long_ = found.where("long").select("conv_id").alias("l")
    if long_.isEmpty():
        return short
    rest = rows.alias("r").join(long_, F.col("r.conv_id").eqNullSafe(F.col("l.conv_id")), "left_semi")
    return short.unionByName(in_passes(rest))
