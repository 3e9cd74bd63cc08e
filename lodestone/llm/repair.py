"""Repair of the turn structure of conversations by bidirectional Dijkstra over the edit lattice.

A place of the lattice is a number of turns taken and a state of the pattern ``(s?(ua)+)?``
over role initials: nothing yet, after the system's turn, after a user's, after an assistant's. Every edit
is an edge: keep, rerole or delete take the next turn, insert takes none. From the first place and
from the two that the pattern ends in, heaps grow towards each other, the cheaper one first, until their tops together
cost more than the best crossing; by then every equally cheap path has a crossing, and the least
audit, a string of edits' initials, is that of the least crossing. No audit of a place is the
beginning of another that costs the same, so the least whole is made of least parts.

Ordinary conversations are searched in one piece, in tasks that sort them. One with very many turns is sorted over all tasks by
range and cut into blocks; each block is searched from every state to every state, blocks are
joined two by two, and the chosen audit is cut back into the blocks' parts. Only the last step, a
digest of the repaired text, goes through a long conversation in order; it holds one batch and one
block's audit at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.stages import broadcast_if_small, materialise

#: White space that makes no text, and ends of sentences.
GAPS, STOPS = " \t\n\x0b\f\r", ".!?"
#: Costs of edits, and of a truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Turns, or bytes of text, from which a conversation is long; turns of a block.
LONG, LONG_BYTES, BLOCK = 1000, 16 << 20, 256
#: Searches whose results are kept in a process.
SEARCHES = 100_000
#: States: nothing, after s, after u, after a; and those that the pattern ends in.
STATES, ENDS = range(4), (0, 3)
#: What a state asks for next, and the state after that.
NEXT = [("user", 2), ("user", 2), ("assistant", 3), ("user", 2)]
#: Faults of a turn.
OK, BLANK, DUPLICATE, CUT = range(4)


def _edges() -> list[list[list[tuple[int, int, str]]]]:
    """For each symbol (3 * role class + fault class) and state: the state after, cost and letter of each edit."""
    table = []
    for role in "sua-":
        for fault in ("", "cut", "gone"):
            rows = []
            for state in STATES:
                out, more = [(state, DELETE, "D")], TRUNCATED if fault == "cut" else 0
                if fault != "gone":
                    wanted, after = NEXT[state]
                    if role == wanted[0]:
                        out.append((after, KEEP + more, "K"))
                    elif role == "s" and state == 0:
                        out.append((1, KEEP + more, "K"))
                    out.append((after, REROLE + more, "R"))
                rows.append(out)
            table.append(rows)
    return table


EDGES = _edges()


def search(symbols: bytes, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """The least cost, and the least audit of that cost, of repairing ``symbols`` from a state to one of ``ends``."""
    n = len(symbols)
    ahead, back = {(0, start): (0, "")}, {(n, e): (0, "") for e in ends}
    done: tuple[dict, dict] = {}, {}
    # of equal costs, what free edges lead to comes after what they come from
    heaps = [(0, 0, start)], [(0, -n, e) for e in ends]
    heapq.heapify(heaps[1])
    best = None

    def reach(side: int, place: tuple[int, int], cost: int, audit: str) -> None:
        nonlocal best
        mine, other = (ahead, back) if side == 0 else (back, ahead)
        if place not in mine or (cost, audit) < mine[place]:
            if place not in mine or cost < mine[place][0]:
                heapq.heappush(heaps[side], (cost, place[0] if side == 0 else -place[0], place[1]))
            mine[place] = cost, audit
            if place in other and (best is None or cost + other[place][0] < best):
                best = cost + other[place][0]

    if (0, start) in back:
        best = 0
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, i, state = heapq.heappop(heaps[side])
        place = abs(i), state
        labels = ahead if side == 0 else back
        if place in done[side] or cost > labels[place][0]:
            continue
        i, audit = abs(i), labels[place][1]
        done[side][place] = cost, audit
        if side == 0:
            reach(0, (i, NEXT[state][1]), cost + INSERT, audit + "I")
            if i < n:
                for after, more, letter in EDGES[symbols[i]][state]:
                    reach(0, (i + 1, after), cost + more, audit + letter)
        else:
            for before in STATES:
                if NEXT[before][1] == state:
                    reach(1, (i, before), cost + INSERT, "I" + audit)
            if i:
                for before in STATES:
                    for after, more, letter in EDGES[symbols[i - 1]][before]:
                        if after == state:
                            reach(1, (i - 1, before), cost + more, letter + audit)
    if best is None:
        return None
    # all crossings of the least cost, at a place and over an edge; where the searches begin, their labels are final
    done[0].setdefault((0, start), (0, ""))
    for e in ends:
        done[1].setdefault((n, e), (0, ""))
    audits = []
    for (i, state), (cost, audit) in done[0].items():
        over = [(i, state, 0, ""), (i, NEXT[state][1], INSERT, "I")]
        if i < n:
            over += [(i + 1, *edge) for edge in EDGES[symbols[i]][state]]
        for j, after, more, letter in over:
            rest = done[1].get((j, after))
            if rest is not None and cost + more + rest[0] == best:
                audits.append(audit + letter + rest[1])
    return best, min(audits)


def faults(roles: list[str], texts: list[str]) -> list[int]:
    """The first fault of each turn of a whole conversation."""
    seen, out = set(), []
    for role, text in zip(roles, texts, strict=True):
        bare = text.rstrip(GAPS)
        out.append(BLANK if not bare else DUPLICATE if (role, text) in seen else OK if bare[-1] in STOPS else CUT)
        seen.add((role, text))
    return out


def symbol(role: str, fault: int) -> int:
    return 3 * (at if role and (at := "sua".find(role[0])) >= 0 else 3) + (0 if fault == OK else 1 if fault == CUT else 2)


def illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def damage(conversations: DataFrame, kinds: int = 20) -> DataFrame:
    """``conv_id, turn, role, text`` after the faults that a hash of conversation and turn calls for.

    Null roles and texts, and nulls in what is hashed, become one space.
    """
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % kinds
    text = F.coalesce("text", space)
    rows = conversations.select("conv_id", "turn", kind.alias("kind"), F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"), F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("kind <> 0").select("conv_id", "turn", "role", "text", times.alias("copy")).drop("copy")


#: What is known of a conversation besides its turns.
HEAD = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
_ROWS = "place long, edit string, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_NAMES = ["conv_id", "place", "edit", "role", "text", *HEAD]


class _Out:
    """Rows of repaired conversations on their way into batches: a head, then the turns that remain."""

    def __init__(self, kind: pa.DataType):
        self.types = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * 6, pa.string()]
        self.rows: list[tuple] = []
        self.size = 0

    def head(self, conv: object, *values: object) -> None:
        self.rows.append((conv, 0, None, None, None, *values))

    def turn(self, conv: object, place: int, edit: str, role: str, text: str) -> None:
        self.rows.append((conv, place, edit, role, text, *[None] * 7))
        self.size += len(text)

    def batches(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (last or len(self.rows) >= 4000 or self.size >= 4 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*self.rows, strict=True), self.types, strict=True)], _NAMES)
            self.rows, self.size = [], 0


def _apply(audit: str, state: int, turns: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """Edit, role and text of what an audit leaves of turns, from a state on."""
    given = iter(turns)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(given)
        if letter == "D":
            continue
        wanted, after = NEXT[state]
        if letter == "K":
            state = 1 if role[0] == "s" else after
        else:
            role, state = wanted, after
        yield letter, role, text


def _ordinary(rows: DataFrame) -> DataFrame:
    """Heads and turns of conversations that a task can hold one of."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, str]] = {}
        now, turns = None, []
        out = None

        def close() -> None:
            whole = [t for t in turns if t[1] is not None]
            roles, texts = [t[1] for t in whole], [t[2] for t in whole]
            found = faults(roles, texts)
            key = bytes(map(symbol, roles, found))
            got = held.get(key)
            if got is None:
                if len(held) >= SEARCHES:
                    held.clear()
                got = held[key] = search(key, 0, ENDS)
            known = [t[0] for t in whole if t[0] is not None]
            gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
            out.head(now, gaps, *(found.count(f) for f in (BLANK, DUPLICATE, CUT)), illegal([r[:1] for r in roles]), *got)
            for place, turn in enumerate(_apply(got[1], 0, zip(roles, texts, strict=True)), 1):
                out.turn(now, place, *turn)

        for batch in batches:
            out = out or _Out(batch.schema.field(0).type)
            for conv, *turn in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if conv != now and turns:
                    close()
                    turns = []
                    yield from out.batches()
                now = conv
                turns.append(turn)
        if turns:
            close()
            yield from out.batches(True)

    ordered = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {kind}, {_ROWS}")


def _join(left: dict, right: dict) -> dict:
    """Two neighbouring parts as one: for both states the cost, the audit, and the state between."""
    out = {}
    for s in STATES:
        for t in STATES:
            ways = [(left[s, m][0] + right[m, t][0], m) for m in STATES if (s, m) in left and (m, t) in right]
            if ways:
                least = min(ways)[0]
                out[s, t] = (least, *min((left[s, m][1] + right[m, t][1], m) for c, m in ways if c == least))
    return out


def _long(rows: DataFrame, partitions: int) -> DataFrame:
    """Heads and turns of conversations of any length."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    own = materialise(rows.select("conv_id", "turn", "role", "text", F.sha2("text", 256).alias("digest"), F.monotonically_increasing_id().alias("rid")), "turns")
    first = own.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn", "rid")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.rid").alias("first"))
    marked = own.join(first.hint("merge"), F.expr("conv_id <=> c and role = r and digest = d"), "left")
    bare = F.rtrim(F.col("text"), F.lit(GAPS))
    fault = F.when(bare == "", BLANK).when(F.col("first") != F.col("rid"), DUPLICATE).when(F.substring(bare, -1, 1).isin(*STOPS), OK).otherwise(CUT)
    keys = ["conv_id", "turn", "role", "text", "rid"]
    ordered = marked.select(*keys, fault.alias("fault")).repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)
    names = ["conv_id", "part", "block", "pos", "role", "text", "matrix"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, now, held, out, types = TaskContext.get().partitionId(), 0, None, [], [], None

        def close() -> None:
            key = bytes(symbol(role, fault) for role, _, fault in held)
            found = {f"{s}{t}": got for s in STATES for t in STATES if (got := search(key, s, (t,))) is not None}
            fault = [x[2] for x in held]
            about = {"costs": found, "counts": [fault.count(f) for f in (BLANK, DUPLICATE, CUT)], "illegal": illegal([r[:1] for r, *_ in held]), "ends": [held[0][0][:1], held[-1][0][:1]]}
            out.append((now, part, block, -1, None, None, json.dumps(about)))
            out.extend((now, part, block, i, role, text, None) for i, (role, text, _) in enumerate(held))

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

        for batch in batches:
            types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            for conv, role, text, fault in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "role", "text", "fault")), strict=True):
                if held and (conv != now or len(held) == BLOCK):
                    close()
                    held, block = [], block + 1
                    yield batch_of()
                    out = []
                now = conv
                held.append((role, text, fault))
        if held:
            close()
            yield batch_of()

    blocks = materialise(ordered.mapInArrow(cut, f"conv_id {kind}, part int, block int, pos int, role string, text string, matrix string"), "blocks")

    def choose(table: pa.Table) -> pa.Table:
        about = [json.loads(x) for x in table.column("matrix").to_pylist()]
        order = sorted(range(len(about)), key=lambda i: (table.column("part")[i].as_py(), table.column("block")[i].as_py()))
        table, about = table.take(order), [about[i] for i in order]
        levels = [[{(int(k[0]), int(k[1])): (*v, 0) for k, v in x["costs"].items()} for x in about]]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([_join(*last[i : i + 2]) if i + 1 < len(last) else last[i] for i in range(0, len(last), 2)])
        cost, audit, end = min((*levels[-1][0][0, e][:2], e) for e in ENDS if (0, e) in levels[-1][0])
        ways = [(0, end)]
        for low, high in zip(levels[-2::-1], levels[:0:-1], strict=True):
            down = []
            for i, (s, t) in enumerate(ways):
                m = high[i][s, t][2]
                down += [(s, m), (m, t)] if 2 * i + 1 < len(low) else [(s, t)]
            ways = down
        bad = sum(x["illegal"] for x in about) + sum(illegal([a["ends"][1], b["ends"][0]]) for a, b in zip(about, about[1:], strict=False))
        place, out = 1, []
        for i, way in enumerate(ways):
            own = levels[0][i][way][1]
            top = {"counts": [sum(x["counts"][k] for x in about) for k in range(3)], "illegal": bad, "cost": cost, "audit": audit} if not i else None
            out.append(json.dumps({"state": way[0], "place": place, "own": own, "head": top}))
            place += len(own) - own.count("D")
        return pa.table({"conv_id": table.column("conv_id"), "part": table.column("part"), "block": table.column("block"), "plan": pa.array(out, pa.string())})

    plans = blocks.where("pos = -1").select("conv_id", "part", "block", "matrix").groupBy("conv_id").applyInArrow(choose, f"conv_id {kind}, part int, block int, plan string")
    span = own.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long").alias("gaps")).select(F.col("conv_id").alias("c"), F.coalesce("gaps", F.lit(0)).alias("gaps"))
    plans = plans.join(span, F.expr("conv_id <=> c"), "left").select("conv_id", "part", "block", F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "plan", "gaps")
    turns = blocks.where("pos >= 0").select("conv_id", "part", "block", "pos", "role", "text", F.lit(None).cast("string").alias("plan"), F.lit(None).cast("long").alias("gaps"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's plan, then its turns, each of which takes the edits up to its own."""
        out, plan, edits, state, place, now = None, None, iter(""), 0, 1, None

        def take(role: str | None, text: str | None) -> None:
            """Edits up to the one that takes the given turn; without one, those that are left."""
            nonlocal state, place
            for letter in edits:
                if letter == "I":
                    out.turn(now, place, letter, NEXT[state][0], "")
                    state, place = NEXT[state][1], place + 1
                    continue
                if letter != "D":
                    after = 1 if letter == "K" and role[0] == "s" else NEXT[state][1]
                    out.turn(now, place, letter, role if letter == "K" else NEXT[state][0], text)
                    state, place = after, place + 1
                return

        for batch in batches:
            out = out or _Out(batch.schema.field(0).type)
            for conv, pos, role, text, found, gaps in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "pos", "role", "text", "plan", "gaps")), strict=True):
                if pos < 0:
                    take(None, None)
                    now, plan = conv, json.loads(found)
                    edits, state, place = iter(plan["own"]), plan["state"], plan["place"]
                    if plan["head"]:
                        h = plan["head"]
                        out.head(now, gaps, *h["counts"], h["illegal"], h["cost"], h["audit"])
                else:
                    take(role, text)
                yield from out.batches()
        if out:
            take(None, None)
            yield from out.batches(True)

    both = plans.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "part", "block", "pos")
    return both.mapInArrow(follow, f"conv_id {kind}, {_ROWS}")


def repaired(turns: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Every conversation's head, then what remains of its turns, in order within partitions.

    ``turns`` has ``conv_id, turn, role, text``; null roles and texts become one space. ``place`` is 0
    for a head, which has :data:`HEAD`, and counts the remaining turns from 1; those have
    ``edit`` (K, R or I), ``role`` and ``text``. Turns are taken by turn (nulls first), then role and text. A
    turn's first fault counts: blank, duplicate (role and text were there before), truncated (its last
    character but white space ends no sentence). ``known`` names conversations (``conv_id``)
    that have a head even without turns. A null conversation id is an id of its own. Rows given
    twice are duplicates; other columns are not read; an empty table gives an empty result.
    """
    spark = turns.sparkSession
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    size = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    long = materialise(size.where((F.col("n") > LONG) | (F.col("bytes") > LONG_BYTES)).select(F.col("conv_id").alias("long_id")), "long")
    if known is not None:
        none = known.select("conv_id").distinct().select("conv_id", *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "role", "text")))
        rows = rows.unionByName(none)
    if long.isEmpty():
        return _ordinary(rows)
    ids, same = broadcast_if_small(long), F.expr("conv_id <=> long_id")
    hot = rows.where("role is not null").join(ids, same, "left_semi")
    return _ordinary(rows.join(ids, same, "left_anti")).unionByName(_long(hot, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def repaired_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text``: the turns of every conversation after repair."""
    return repaired(turns).where("place > 0").select("conv_id", "place", "edit", "role", "text")


def summaries(turns: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``conv_id``, :data:`HEAD` and ``repaired_sha256`` (of ``role:text`` lines) of every conversation of :func:`repaired`."""
    rows = repaired(turns, known)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest = None, None
        for batch in batches:
            out = []
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in _NAMES]
            for conv, place, _, role, text, *values in zip(*cols, strict=True):
                if place == 0:
                    if head:
                        out.append((*head, digest.hexdigest()))
                    head, digest = (conv, *values), hashlib.sha256()
                else:
                    digest.update(f"{'' if place == 1 else chr(10)}{role}:{text}".encode())
            if out:
                yield pack(out, batch.schema.field(0).type)
        if head:
            yield pack([(*head, digest.hexdigest())], batch.schema.field(0).type)

    def pack(out: list[tuple], first: pa.DataType) -> pa.RecordBatch:
        types = [first, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["conv_id", *HEAD, "repaired_sha256"])

    return rows.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """:func:`summaries` of damaged conversations, with a row for each original one."""
    return summaries(damage(conversations), conversations)


def oracle_sql() -> str:
    """The rows of :func:`repair_damaged` in DuckDB's SQL: costs and audits of the four states, turn by turn.

    A state's cost and audit are one string, nine digits and then the letters, so that the least string is the
    least audit of the least cost.
    """
    never, first = "'500000000'", "['000000000', '500000000', '000000003I', '000000006II']"

    def add(path: str, cost: str, letter: str) -> str:
        return f"(lpad((left({path}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({path}, 10) || '{letter}')"

    def taken(paths: list[str], wanted: str) -> str:
        kept = [add(p, f"CASE x[2] WHEN 'cut' THEN {TRUNCATED} ELSE 0 END", "K") for p in paths]
        changed = [add(p, f"{REROLE} + CASE x[2] WHEN 'cut' THEN {TRUNCATED} ELSE 0 END", "R") for p in paths]
        return f"CASE WHEN x[2] = 'gone' THEN {never} WHEN x[1] = '{wanted}' THEN least({', '.join(kept)}) ELSE least({', '.join(changed)}) END"

    system = f"CASE WHEN x[2] <> 'gone' AND x[1] = 's' THEN {add('a[1]', f'CASE x[2] WHEN {chr(39)}cut{chr(39)} THEN {TRUNCATED} ELSE 0 END', 'K')} ELSE {never} END"
    gone = [add(f"a[{i}]", str(DELETE), "D") for i in range(1, 5)]
    took = f"[[{gone[0]}, least({gone[1]}, {system}), least({gone[2]}, {taken(['a[1]', 'a[2]', 'a[4]'], 'u')}), least({gone[3]}, {taken(['a[3]'], 'a')})]]"
    user = f"least(q[3], {', '.join(add(f'q[{i}]', str(INSERT), 'I') for i in (1, 2, 4))})"
    step = f"list_transform({took}, lambda q: [q[1], q[2], {user}, least(q[4], {add(user, str(INSERT), 'I')})])[1]"
    bits = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    named = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    gaps = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
        WITH hashed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({named}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: {bits}), 4294967295) % 20 AS kind FROM conversations),
        damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed WHERE kind <> 0),
        ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM damaged),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, rtrim(text, {gaps}) AS bare FROM ordered),
        found AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) IN ('.', '!', '?') THEN 'ok' ELSE 'truncated' END AS fault,
            lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM placed),
        whole AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
            count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
            count(*) FILTER (n > 1 AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
            list([left(role, 1), CASE fault WHEN 'ok' THEN 'ok' WHEN 'truncated' THEN 'cut' ELSE 'gone' END] ORDER BY n) AS turns FROM found GROUP BY conv_id),
        paths AS (SELECT *, list_reduce(list_prepend({first}, turns), lambda a, x: {step}) AS last FROM whole),
        best AS (SELECT *, least(last[1], last[4]) AS path FROM paths),
        letters AS (SELECT conv_id, j, substr(path, 9 + j, 1) AS letter FROM (SELECT conv_id, path, unnest(range(1, length(path) - 8)) AS j FROM best) u),
        edits AS (SELECT conv_id, j, letter, count(*) FILTER (letter <> 'I') OVER w AS n, count(*) FILTER (letter <> 'D') OVER w AS place FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
        joined AS (SELECT e.*, f.role, f.text FROM edits e LEFT JOIN found f ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND e.n = f.n AND e.letter <> 'I' WHERE letter <> 'D'),
        led AS (SELECT *, max(CASE WHEN place = 1 AND letter = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS led FROM joined),
        lines AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS lines FROM led GROUP BY conv_id)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            coalesce(left(path, 9)::BIGINT, 0) AS cost, coalesce(substr(path, 10), '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best b ON o.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN lines l ON o.conv_id IS NOT DISTINCT FROM l.conv_id"""
