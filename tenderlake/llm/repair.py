"""Repair of a conversation's structure by cheapest edits, through its bidirectional tight-arc DAG.

Nodes are (rows taken, state of the role pattern); arcs keep, rerole or delete the next row, or
insert one.  Least costs from the start and to the end show which arcs lie on a cheapest repair
(tight: cost before + arc + cost after = total).  Among all of these the ASCII-least series of edits
is read off by walking the set of nodes that the letters chosen so far can reach.

Rows are sorted by ranges of (conversation, turn), so that one conversation, however large, lies in
many tasks.  A conversation that lies whole in a task is repaired there.  Others are cut into
segments: a segment's costs are a small matrix, a scan over one short row a segment gives the costs
at its borders, each segment then states its letters for the few node sets that may enter it, and a
second scan picks among them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, pack, partitions, small_batches, table, trimmed, trimmed_batches, unpack

#: States: nothing yet, after the system row, after a user row, after an assistant row.  The first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ENDS = (START, ASSISTANT)
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1
FAR = 1 << 60
BLANKS = " \t\n\x0b\x0c\r"
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = {"su", "ua", "au"}


def _arcs(initial: str, fault: int) -> list[tuple[str, int, int, int]]:
    """(letter, from, to, cost) of one row, letters ascending."""
    out = [("D", v, v, DELETE) for v in range(4)]
    if fault in (BLANK, DUPLICATE):
        return out
    more = CUT_SHORT if fault == TRUNCATED else 0
    if initial == "s":
        out.append(("K", START, SYSTEM, KEEP + more))
    out += [("K", v, w, KEEP + more) for v, w in NEXT.items() if initial == {USER: "u", ASSISTANT: "a"}[w]]
    return out + [("R", v, w, REROLE + more) for v, w in NEXT.items()]


ARCS = {(i, f): _arcs(i, f) for i in ("s", "u", "a", "") for f in range(4)}


def _inserted(f: list[int]) -> list[int]:
    """Least costs of the nodes of a layer, after inserts."""
    user = min(f[USER], f[START] + INSERT, f[SYSTEM] + INSERT, f[ASSISTANT] + INSERT)
    return [f[START], f[SYSTEM], user, min(f[ASSISTANT], user + INSERT)]


def _to_insert(b: list[int]) -> list[int]:
    """Least costs from the nodes of a layer to the end, where inserts may come first."""
    user = min(b[USER], b[ASSISTANT] + INSERT)
    return [min(b[START], user + INSERT), min(b[SYSTEM], user + INSERT), user, min(b[ASSISTANT], user + INSERT)]


#: Costs to the end after the last row.
LAST = _to_insert([0 if v in ENDS else FAR for v in range(4)])


class Rows:
    """Rows of one conversation, or of a segment of it, in order."""

    def __init__(self, turns=(), roles=(), texts=(), faults=None):
        self.turns, self.roles, self.texts, self.faults = list(turns), list(roles), list(texts), faults

    def add(self, turn, role: str, text: str) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)

    def digest(self, i: int) -> bytes:
        role = self.roles[i].encode()
        return hashlib.blake2b(len(role).to_bytes(8, "little") + role + self.texts[i].encode(), digest_size=16).digest()

    def judge(self, seen: set[bytes]) -> None:
        """The first fault of each row; ``seen`` has the digests of earlier rows and is added to."""
        self.faults = []
        for i, text in enumerate(self.texts):
            said = text.rstrip(BLANKS)
            if not said:
                self.faults.append(BLANK)
            elif (d := self.digest(i)) in seen:
                self.faults.append(DUPLICATE)
            else:
                seen.add(d)
                self.faults.append(NONE if said[-1] in ".!?" else TRUNCATED)

    def arcs(self):
        return [ARCS[r[:1] if r[:1] in ("s", "u", "a") else "", f] for r, f in zip(self.roles, self.faults)]

    def forward(self, f: list[int], arcs=None) -> list[list[int]]:
        """Costs of all layers, from those of the first before its inserts; the last is before its own inserts too."""
        out = []
        for row in self.arcs() if arcs is None else arcs:
            f = _inserted(f)
            out.append(f)
            g = [FAR] * 4
            for _, v, w, c in row:
                if f[v] + c < g[w]:
                    g[w] = f[v] + c
            f = g
        return [*out, f]

    def backward(self, b: list[int], arcs=None) -> list[list[int]]:
        """Costs to the end from all layers, given those of the last."""
        out = [b]
        for row in reversed(self.arcs() if arcs is None else arcs):
            a = [FAR] * 4
            for _, v, w, c in row:
                if b[w] + c < a[v]:
                    a[v] = b[w] + c
            b = _to_insert(a)
            out.append(b)
        return out[::-1]

    def matrix(self) -> list[int]:
        """Least costs from each node before the segment to each after its rows, in 16 numbers."""
        arcs = self.arcs()
        return [min(x, FAR) for v in range(4) for x in self.forward([0 if w == v else FAR for w in range(4)], arcs)[-1]]

    def letters(self, entry: frozenset[int], f, b, total: int, last: bool) -> tuple[str, frozenset[int]]:
        """The least letters from a set of nodes, and the set after them."""
        arcs, out, at, layer = self.arcs(), [], entry, 0
        f = [*f[:-1], _inserted(f[-1])]
        while layer < len(arcs) or last and not any(v in ENDS and f[layer][v] == total for v in at):
            best, to = "Z", set()
            for v, w in NEXT.items():
                if v in at and f[layer][v] + INSERT + b[layer][w] == total:
                    best = "I"
                    to.add(w)
            for letter, v, w, c in arcs[layer] if layer < len(arcs) else ():
                if letter <= best and v in at and f[layer][v] + c + b[layer + 1][w] == total:
                    if letter < best:
                        best, to = letter, set()
                    to.add(w)
            if not to:
                raise AssertionError("no tight arc leaves the set")
            out.append(best)
            at = frozenset(to)
            layer += best != "I"
        return "".join(out), at

    def begins_with_system(self, letters: str) -> bool | None:
        """Whether the first row that stays is a kept system row; None where none stays."""
        for i, letter in enumerate(letters):
            if letter != "D":
                return letter == "K" and self.roles[i].startswith("s")
        return None

    def messages(self, letters: str, place: int, system: bool) -> list[tuple[str, str, str]]:
        """(edit, role, text); ``place`` rows stay before these, and ``system`` says whether the first of all is one."""
        out, i = [], 0
        for letter in letters:
            role, text = ("", "") if letter == "I" else (self.roles[i], self.texts[i])
            if letter in "RI":
                role = ("user", "assistant")[(place - system) % 2]
            out.append((letter, role, text))
            place += letter != "D"
            i += letter != "I"
        return out

    def facts(self) -> tuple:
        """(first and last known turn, distinct known turns, blank, duplicate, truncated, illegal, first and last initial)."""
        turns = [t for t in self.turns if t is not None]
        initials = [r[:1] for r in self.roles]
        return (
            turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)), *(self.faults.count(k) for k in (BLANK, DUPLICATE, TRUNCATED)),
            sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), initials[0] if initials else None, initials[-1] if initials else None,
        )


def joined(a: tuple, b: tuple) -> tuple:
    """Facts of two runs of rows, the second after the first."""
    low, high = (b[0] if a[0] is None else a[0]), (a[1] if b[1] is None else b[1])
    both = a[1] is not None and a[1] == b[0]
    crossing = a[8] is not None and b[7] is not None and a[8] + b[7] not in LEGAL
    return (low, high, a[2] + b[2] - both, a[3] + b[3], a[4] + b[4], a[5] + b[5], a[6] + b[6] + crossing,
            b[7] if a[7] is None else a[7], a[8] if b[8] is None else b[8])


def _figures(facts: tuple, cost: int) -> list[int]:
    """gaps, blank, duplicate, truncated, illegal, cost."""
    low, high, distinct, blank, duplicate, truncated, illegal, *_ = facts
    return [0 if low is None else high - low + 1 - distinct, blank, duplicate, truncated, illegal, cost]


def mend(rows: Rows) -> tuple[list[int], list[tuple[str, str, str]]]:
    """The figures and the edits of one whole conversation."""
    rows.judge(set())
    arcs = rows.arcs()
    f, b = rows.forward([0, FAR, FAR, FAR], arcs), rows.backward(LAST, arcs)
    total = b[0][START]
    letters, _ = rows.letters(frozenset([START]), f, b, total, True)
    return _figures(rows.facts(), total), rows.messages(letters, 0, bool(rows.begins_with_system(letters)))


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
MESSAGES = "array<struct<edit:string,role:string,text:string>>"


def _message_lists(lists) -> pa.Array:
    flat = [m for x in lists for m in x]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    fields = [pa.array([m[i] for m in flat], pa.string()) for i in range(3)]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, names=["edit", "role", "text"]))


@dataclass(frozen=True)
class Settings:
    """A segment ends after so many rows or bytes; shorter whole conversations are repaired at once."""

    segment_rows: int = 4096
    segment_bytes: int = 4 << 20


def _repaired_or_cut(batches, s: Settings, id_type):
    """Rows (conv, figures, messages, pid, seq, payload): whole conversations repaired, segments of the others."""
    fresh = lambda: ([], [], [])
    done, size, pid, seq = fresh(), 0, None, 0
    conv, rows, held, cut, begun, first = None, Rows(), 0, False, False, True

    def flush_done():
        convs, figures, lists = done
        n = len(convs)
        return pa.RecordBatch.from_arrays(
            [pa.array(convs, id_type), *(pa.array([x[i] for x in figures], pa.int64()) for i in range(6)), _message_lists(lists),
             pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)

    def segment():
        return pa.RecordBatch.from_arrays(
            [pa.array([conv], id_type), *(pa.nulls(1, pa.int64()) for _ in range(6)), _message_lists([[]]), pa.array([pid], pa.int32()),
             pa.array([seq], pa.int32()), pa.array([pack((rows.turns, rows.roles, rows.texts))], pa.binary())], names=names)

    names = ["conv", *FIGURES, "messages", "pid", "seq", "payload"]
    for b in batches:
        for c, turn, role, text, copies, pid in zip(*(b.column(i).to_pylist() for i in range(6))):
            if begun and c != conv:
                if first or cut:
                    yield segment()
                    seq += 1
                else:
                    figures, messages = mend(rows)
                    for x, y in zip(done, (conv, figures, messages)):
                        x.append(y)
                    size += held + 100
                    if size >= s.segment_bytes or len(done[0]) >= 1000:
                        yield flush_done()
                        done, size = fresh(), 0
                rows, held, cut, first = Rows(), 0, False, False
            conv, begun = c, True
            for _ in range(copies):
                rows.add(turn, role, text)
                held += len(text) + 50
                if len(rows.texts) >= s.segment_rows or held >= s.segment_bytes:
                    yield segment()
                    rows, held, cut, seq = Rows(), 0, True, seq + 1
    if begun:
        yield segment()
    if done[0]:
        yield flush_done()


def _digests(batches, id_type):
    """Rows (conv, pid, seq, digest) of the distinct rows of segments that are not blank."""
    for b in batches:
        for conv, pid, seq, payload in zip(*(b.column(i).to_pylist() for i in range(4))):
            rows, seen = Rows(*unpack(payload)), set()
            rows.judge(seen)
            n = len(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv] * n, id_type), pa.array([pid] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(sorted(seen), pa.binary())],
                names=["conv", "pid", "seq", "digest"])


def _judged(batches, id_type):
    """Segments with their faults, facts and cost matrix; the last column has digests of rows seen in earlier segments."""
    for b in batches:
        for conv, pid, seq, payload, seen in zip(*(b.column(i).to_pylist() for i in range(5))):
            turns, roles, texts = unpack(payload)
            rows = Rows(turns, roles, texts)
            rows.judge(set(seen or []))
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], id_type), pa.array([pid], pa.int32()), pa.array([seq], pa.int32()),
                 pa.array([pack((turns, roles, texts, rows.faults))], pa.binary()), pa.array([pack(rows.facts())], pa.binary()),
                 pa.array([rows.matrix()], pa.list_(pa.int64()))],
                names=["conv", "pid", "seq", "payload", "facts", "matrix"])


def _borders(group: pa.Table) -> pa.Table:
    """Costs before and after every segment of a conversation, from the segments' matrices."""
    group = group.sort_by([("pid", "ascending"), ("seq", "ascending")])
    every = [np.array(m, np.int64).reshape(4, 4) for m in group.column("matrix").to_pylist()]
    f, fs = np.array([0, FAR, FAR, FAR], np.int64), []
    for m in every:
        fs.append(f)
        f = np.minimum((f[:, None] + m).min(axis=0), FAR)
    b, bs = np.array(LAST, np.int64), []
    for m in reversed(every):
        bs.append(b)
        b = np.minimum((m + b[None, :]).min(axis=1), FAR)
    n = len(every)
    return pa.table({
        "pid": group.column("pid"), "seq": group.column("seq"), "before": pa.array([x.tolist() for x in fs], pa.list_(pa.int64())),
        "after": pa.array([x.tolist() for x in bs[::-1]], pa.list_(pa.int64())), "total": pa.array([int(b[START])] * n, pa.int64()),
        "first": pa.array([i == 0 for i in range(n)]), "last": pa.array([i == n - 1 for i in range(n)]),
    })


def _choices(batches, id_type):
    """For every set of nodes by which a cheapest repair may enter a segment: its letters and the set after them."""
    names = ["conv", "pid", "seq", "entry", "exit", "letters", "stay", "system", "facts", "total"]
    for batch in batches:
        for conv, pid, seq, payload, facts, before, after, total, first, last in zip(*(batch.column(i).to_pylist() for i in range(10))):
            rows, out = Rows(*unpack(payload)), []
            arcs = rows.arcs()
            f, b = rows.forward(before, arcs), rows.backward(after, arcs)
            nodes = [START] if first else [v for v in range(4) if before[v] + b[0][v] == total]
            for n in range(1, len(nodes) + 1):
                for entry in map(frozenset, combinations(nodes, n)):
                    letters, to = rows.letters(entry, f, b, total, last)
                    out.append((sum(1 << v for v in entry), sum(1 << v for v in to), letters, len(letters) - letters.count("D"), rows.begins_with_system(letters)))
            k = len(out)
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv] * k, id_type), pa.array([pid] * k, pa.int32()), pa.array([seq] * k, pa.int32()),
                 *(pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)), pa.array([facts] * k, pa.binary()), pa.array([total] * k, pa.int64())],
                names=names)


def _picked(group: pa.Table) -> pa.Table:
    """Of each segment of a conversation the entry that the segments before it lead to, and what it needs to know of them."""
    by: dict = {}
    for pid, seq, entry, to, stay, system, facts, total in zip(*(group.column(c).to_pylist() for c in ("pid", "seq", "entry", "exit", "stay", "system", "facts", "total"))):
        by.setdefault((pid, seq), {})[entry] = (to, stay, system, facts, total)
    at, place, lead, all_facts, out = 1 << START, 0, None, None, []
    for (pid, seq), entries in sorted(by.items()):
        to, stay, system, facts, total = entries[at]
        lead = system if lead is None else lead
        out.append((pid, seq, at, place, bool(lead)))
        at, place = to, place + stay
        all_facts = unpack(facts) if all_facts is None else joined(all_facts, unpack(facts))
    figures = _figures(all_facts, total)
    n = len(out)
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
    return pa.table({
        **{c: pa.array([x[i] for x in out], t) for i, (c, t) in enumerate(zip(("pid", "seq", "entry", "place", "lead"), kinds))},
        "part": pa.array(range(n), pa.int32()), "parts": pa.array([n] * n, pa.int32()), **{c: pa.array([figures[i]] * n, pa.int64()) for i, c in enumerate(FIGURES)},
    })


def _told(batches, id_type):
    """Messages of segments whose letters are known."""
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
        for conv, payload, letters, place, lead, *rest in zip(*cols):
            rows = Rows(*unpack(payload))
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], id_type), pa.array([rest[0]], pa.int32()), pa.array([rest[1]], pa.int32()), *(pa.array([x], pa.int64()) for x in rest[2:]),
                 _message_lists([rows.messages(letters, place, lead)])], names=["conv", "part", "parts", *FIGURES, "messages"])


def repair(rows: DataFrame, s: Settings = Settings(), id_col: str = "conv_id", copies: Column | None = None) -> DataFrame:
    """(id, part, parts, gaps, blank, duplicate, truncated, illegal, cost, messages) of every conversation of (id, turn, role, text).

    ``messages`` are (edit, role, text) in order: K kept, R reroled, D deleted, I inserted; what is not deleted
    is the repaired conversation.  A conversation lies in ``parts`` rows (one, unless it is very long), ``part`` from 0.

    Rows are taken by turn, nulls first; rows of one turn by role and text (the first 200 characters of each,
    then a hash).  A null role or text counts as one blank.  Null ids are one conversation.  A row counts
    ``copies`` times (default once; with 0 it only names its conversation).  A row whose role begins with none of
    s, u and a, or is empty, can be reroled or deleted only.  Repeated rows are duplicates, other columns are not
    read, and an empty table gives an empty result.
    """
    spark = rows.sparkSession
    small_batches(spark)
    kind = next(f.dataType for f in rows.schema.fields if f.name == id_col)
    from pyspark.sql.pandas.types import to_arrow_type

    id_type, name = to_arrow_type(kind), kind.simpleString()
    text = rows.select(
        F.col(id_col).alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), (F.lit(1) if copies is None else copies).cast("int").alias("copies"),
    )
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.substring("role", 1, 200), F.substring("text", 1, 200), F.xxhash64("role", "text")]
    dealt = text.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order, F.col("_row")).sortWithinPartitions(
        *order).drop("_row").withColumn("pid", F.spark_partition_id())
    figures = ", ".join(f"{c} long" for c in FIGURES)
    held = materialize(
        dealt.mapInArrow(trimmed_batches(lambda it: _repaired_or_cut(it, s, id_type)),
                         f"conv {name}, {figures}, messages {MESSAGES}, pid int, seq int, payload binary"), "repair")
    out = ["conv", "part", "parts", *FIGURES, "messages"]
    whole = held.where("pid IS NULL").withColumn("part", F.lit(0)).withColumn("parts", F.lit(1)).select(*out)
    cut = held.where("pid IS NOT NULL").select("conv", "pid", "seq", "payload")
    # Rows that an earlier segment of their conversation holds already.
    digests = cut.mapInArrow(trimmed_batches(lambda it: _digests(it, id_type)), f"conv {name}, pid int, seq int, digest binary")
    at = F.struct("pid", "seq")
    seen = digests.withColumn("_first", F.min(at).over(Window.partitionBy("conv", "digest"))).where(at > F.col("_first")).groupBy("pid", "seq").agg(
        F.collect_list("digest").alias("seen"))  # no more than a segment's rows
    judged = materialize(
        cut.join(seen, ["pid", "seq"], "left").select("conv", "pid", "seq", "payload", "seen").mapInArrow(
            trimmed_batches(lambda it: _judged(it, id_type)), f"conv {name}, pid int, seq int, payload binary, facts binary, matrix array<long>"), "repair-judged")
    borders = judged.select("conv", "pid", "seq", "matrix").groupBy("conv").applyInArrow(
        trimmed(_borders), "pid int, seq int, before array<long>, after array<long>, total long, first boolean, last boolean")
    choices = materialize(
        judged.join(borders, ["pid", "seq"]).select("conv", "pid", "seq", "payload", "facts", "before", "after", "total", "first", "last").mapInArrow(
            trimmed_batches(lambda it: _choices(it, id_type)),
            f"conv {name}, pid int, seq int, entry int, exit int, letters string, stay long, system boolean, facts binary, total long"), "repair-choices")
    picked = choices.drop("letters").groupBy("conv").applyInArrow(
        trimmed(_picked), f"pid int, seq int, entry int, place long, lead boolean, part int, parts int, {figures}")
    told = judged.select("conv", "pid", "seq", "payload").join(choices.select("pid", "seq", "entry", "letters").join(picked, ["pid", "seq", "entry"]), ["pid", "seq"])
    parts = told.select("conv", "payload", "letters", "place", "lead", "part", "parts", *FIGURES).mapInArrow(
        trimmed_batches(lambda it: _told(it, id_type)), f"conv {name}, part int, parts int, {figures}, messages {MESSAGES}")
    return whole.unionByName(parts.select(*out)).withColumnRenamed("conv", id_col)


def digest(repaired: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, figures, audit, repaired_sha256): one row a conversation.  Conversations in parts are hashed part by part."""
    kind = next(f.dataType for f in repaired.schema.fields if f.name == id_col)
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    audit = F.array_join(F.transform("messages", lambda m: m["edit"]), "")
    stays = F.filter("messages", lambda m: m["edit"] != "D")
    body = F.array_join(F.transform(stays, lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    told = repaired.select(id_col, "part", "parts", *FIGURES, audit.alias("audit"), (F.size(stays) > 0).alias("any"), body.alias("body"))
    whole = told.where("parts = 1").select(id_col, *FIGURES, "audit", F.sha2("body", 256).alias("repaired_sha256"))

    def run(batches):
        now, names = None, [id_col, *FIGURES, "audit", "repaired_sha256"]

        def close(conv, figures, audits, h, _):
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], id_type), *(pa.array([x], pa.int64()) for x in figures), pa.array(["".join(audits)], pa.string()), pa.array([h.hexdigest()])], names=names)

        for b in batches:
            for conv, part, _, *figures, letters, any_, text in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                if part == 0:
                    if now is not None:
                        yield close(*now)
                    now = [conv, figures, [], hashlib.sha256(), False]
                now[2].append(letters)
                if any_:
                    now[3].update((b"\n" if now[4] else b"") + text.encode())
                    now[4] = True
        if now is not None:
            yield close(*now)

    figures = ", ".join(f"{c} long" for c in FIGURES)
    parted = told.where("parts > 1").repartition(id_col).sortWithinPartitions(id_col, "part").mapInArrow(
        trimmed_batches(run), f"`{id_col}` {kind.simpleString()}, {figures}, audit string, repaired_sha256 string")
    return whole.unionByName(parted)


def damage(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turn, role, text, copies): conversations with seeded faults; ``copies`` is 0 for a dropped row and 2 for a repeated one.

    By crc32 of ``id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats
    it, 4 makes its role user.  A null counts as one blank.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    n = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), blank) for c in ("role", "text"))
    return rows.select(
        id_col, "turn", F.when(n == 4, "user").otherwise(role).alias("role"),
        F.when(n == 1, "").when(n == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(n == 0, 0).when(n == 3, 2).otherwise(1).alias("copies"),
    )


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``, damaged and repaired."""
    broken = damage(table(spark, sf_dir, "conversations"))
    return digest(repair(broken, copies=F.col("copies")))
