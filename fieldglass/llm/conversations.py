"""Repair of conversation structure: generalised LR parsing of the roles with weighted edits.

``GRAMMAR`` says which sequences of role initials are well formed. Its LR table drives a
graph-structured stack: all ways to read the rows so far share their stacks as nodes (a state and
the node it rests on), and ways that end in the same node are merged, the least (cost, audit)
staying. From row to row each node may delete the row, keep it, give it another role, or insert a
turn. ``audit`` has the initials of the edits in order; of the cheapest repairs it is the least.

A conversation is cut into pieces of at most ``PIECE`` rows. One that lies whole in a task and in one piece is
repaired there. The pieces of any other are parsed from every stack that may come in, so a conversation of
any length is spread over tasks, and the outcomes of its pieces, costs and audits, are joined in order.

Rows of one turn are taken by role (null first) and text digest, rows without a turn come first. A
null text is blank, a null or empty role fits no place of the grammar and can only be given another role or
deleted. Null ids form one conversation. Repeated rows are duplicates. Very long texts are read
whole. A conversation without rows has an empty repair, and so has an empty table.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import BLANK_CLASS, crc32_sql, materialise, tidy

#: Well-formed sequences of role initials: (s?(ua)+)?
GRAMMAR = (("S", ""), ("S", "P"), ("P", "sT"), ("P", "T"), ("T", "ua"), ("T", "Tua"))
ROLES = {"u": "user", "a": "assistant"}
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
LEGAL_PAIRS = ("su", "ua", "au")
#: Rows of a conversation that are parsed at once.
PIECE = 512
END = "$"


def lr_states(grammar: tuple) -> tuple[list[frozenset], dict[tuple[int, str], int]]:
    """Item sets (rule, place of the dot) and the moves between them, the first set first."""
    heads = {head for head, _ in grammar}

    def closed(items: set) -> frozenset:
        todo = list(items)
        while todo:
            rule, dot = todo.pop()
            body = grammar[rule][1]
            for k, (head, _) in enumerate(grammar):
                if dot < len(body) and body[dot] == head and head in heads and (k, 0) not in items:
                    items.add((k, 0))
                    todo.append((k, 0))
        return frozenset(items)

    states, moves = [closed({(k, 0) for k, (head, _) in enumerate(grammar) if head == grammar[0][0]})], {}
    for at, items in enumerate(states):
        for symbol in sorted({grammar[r][1][d] for r, d in items if d < len(grammar[r][1])}):
            target = closed({(r, d + 1) for r, d in items if d < len(grammar[r][1]) and grammar[r][1][d] == symbol})
            if target not in states:
                states.append(target)
            moves[at, symbol] = states.index(target)
    return states, moves


class Stacks:
    """The graph-structured stack: nodes are numbered, each is a state on top of another node, equal ones are one."""

    def __init__(self, grammar: tuple = GRAMMAR):
        self.grammar = grammar
        self.states, self.moves = lr_states(grammar)
        self.nodes: list[tuple[int, int]] = [(0, -1)]
        self.number = {(0, -1): 0}
        self.names = [""]
        self.known: dict[tuple[int, str], tuple[int, ...]] = {}

    def put(self, node: int, symbol: str) -> int | None:
        state = self.moves.get((self.nodes[node][0], symbol))
        if state is None:
            return None
        key = (state, node)
        if key not in self.number:
            self.number[key] = len(self.nodes)
            self.nodes.append(key)
            self.names.append(self.names[node] + symbol)
        return self.number[key]

    def reduced(self, node: int) -> list[int]:
        """The node and all that follow from it by reductions."""
        out = [node]
        for at in out:
            for rule, dot in self.states[self.nodes[at][0]]:
                head, body = self.grammar[rule]
                if dot == len(body):
                    base = at
                    for _ in body:
                        base = self.nodes[base][1]
                    to = self.put(base, head)
                    if to is not None and to not in out:
                        out.append(to)
        return out

    def after(self, node: int, symbol: str) -> tuple[int, ...]:
        """Nodes once ``symbol`` is read. A finished rule is reduced at once where its state allows nothing else."""
        if (node, symbol) not in self.known:
            found = []
            for at in self.reduced(node):
                to = self.put(at, symbol)
                while to is not None and len(self.states[self.nodes[to][0]]) == 1:
                    ((rule, dot),) = self.states[self.nodes[to][0]]
                    if dot < len(self.grammar[rule][1]):
                        break
                    base = to
                    for _ in self.grammar[rule][1]:
                        base = self.nodes[base][1]
                    to = self.put(base, self.grammar[rule][0])
                if to is not None:
                    found.append(to)
            self.known[node, symbol] = tuple(found)
        return self.known[node, symbol]

    def accepts(self, node: int) -> bool:
        """Whether the rows may end here: a rule of the first symbol is complete and covers all."""
        for at in self.reduced(node):
            for rule, dot in self.states[self.nodes[at][0]]:
                head, body = self.grammar[rule]
                if head == self.grammar[0][0] and dot == len(body) and len(self.names[at]) == len(body):
                    return True
        return False

    def named(self, name: str) -> int:
        """The node with these symbols on it."""
        at = 0
        for symbol in name:
            at = self.put(at, symbol)
        return at

    def all_nodes(self) -> list[int]:
        """Every node that some sequence of turns leads to."""
        out = [0]
        for node in out:
            out += [to for symbol in "sua" for to in self.after(node, symbol) if to not in out]
        return out


def with_inserts(stacks: Stacks, level: dict) -> dict:
    todo = list(level)
    while todo:
        node = todo.pop()
        cost, audit, turns = level[node]
        for symbol in ROLES:
            way = (cost + INSERT, audit + "I", turns + symbol)
            for to in stacks.after(node, symbol):
                if to not in level or way < level[to]:
                    level[to] = way
                    todo.append(to)
    return level


def step(stacks: Stacks, level: dict, initial: str, must_go: bool, extra: int) -> dict:
    """Least (cost, audit, initials of the repaired turns, ``-`` for a deleted row) of each node after one more row."""
    new: dict = {}

    def offer(node: int, way: tuple) -> None:
        if node not in new or way < new[node]:
            new[node] = way

    for node, (cost, audit, turns) in level.items():
        offer(node, (cost + DELETE, audit + "D", turns + "-"))
        if not must_go:
            if initial:
                for to in stacks.after(node, initial):
                    offer(to, (cost + extra, audit + "K", turns + initial))
            for symbol in ROLES:
                for to in stacks.after(node, symbol):
                    offer(to, (cost + REROLE + extra, audit + "R", turns + symbol))
    return with_inserts(stacks, new)


def parse(stacks: Stacks, start: int, rows: list[tuple[str, bool, int]]) -> dict:
    level = with_inserts(stacks, {start: (0, "", "")})
    for row in rows:
        level = step(stacks, level, *row)
    return level


def is_before(a: tuple | None, b: tuple | None) -> bool:
    """Whether the chained audits of ``a`` come first; chains are (earlier chain, audit, turns) of the same pieces."""
    left, right = [], []
    while a is not b:
        left.append(a[1])
        right.append(b[1])
        a, b = a[0], b[0]
    return "".join(reversed(left)) < "".join(reversed(right))


BLANK_ROW, DUPLICATE_ROW, TRUNCATED_ROW = "blank", "duplicate", "truncated"


def own_fault(text: str | None) -> str:
    """The fault that a text has by itself."""
    stripped = "" if text is None else text.rstrip(" \t\n\x0b\x0c\r")
    return BLANK_ROW if not stripped else "" if stripped[-1] in ".!?" else TRUNCATED_ROW


def shape(role: str | None, fault: str) -> tuple[str, bool, int]:
    """What parsing needs of a row: initial, whether it must go, what keeping it costs."""
    return (role or "")[:1], fault in (BLANK_ROW, DUPLICATE_ROW), TRUNCATED if fault == TRUNCATED_ROW else 0


def tally(rows: list[tuple]) -> dict:
    """Counts over a run of rows (role, fault, turn or None), and what the next run needs of it."""
    initials = [(r[0] or "")[:1] for r in rows]
    turns = [r[2] for r in rows if r[2] is not None]
    return {
        "n": len(rows), **{k: sum(r[1] == k for r in rows) for k in (BLANK_ROW, DUPLICATE_ROW, TRUNCATED_ROW)},
        "illegal": sum(x + y not in LEGAL_PAIRS for x, y in zip(initials, initials[1:])), "first": initials[0], "last": initials[-1],
        "turns": [min(turns), max(turns), len(set(turns))] if turns else None}


def added(a: dict | None, b: dict) -> dict:
    """The counts of two runs that follow each other."""
    if a is None:
        return b
    out = {k: a[k] + b[k] for k in ("n", BLANK_ROW, DUPLICATE_ROW, TRUNCATED_ROW, "illegal")}
    out["illegal"] += a["last"] + b["first"] not in LEGAL_PAIRS
    if a["turns"] and b["turns"]:
        turns = [a["turns"][0], b["turns"][1], a["turns"][2] + b["turns"][2] - (a["turns"][1] == b["turns"][0])]
    else:
        turns = a["turns"] or b["turns"]
    return {**out, "first": a["first"], "last": b["last"], "turns": turns}


def gaps_of(counts: dict) -> int:
    return counts["turns"][1] - counts["turns"][0] + 1 - counts["turns"][2] if counts["turns"] else 0


def repaired(rows: list[tuple[str | None, str | None]], audit: str, turns: str) -> list[tuple[str, str]]:
    """(role, text) of the repaired turns; ``rows`` are the (role, text) that the audit speaks of."""
    out, at = [], 0
    for edit, symbol in zip(audit, turns, strict=True):
        if edit == "I":
            out.append((ROLES[symbol], ""))
            continue
        role, text = rows[at]
        at += 1
        if edit != "D":
            out.append((role if edit == "K" else ROLES[symbol], text))
    return out


def turn_line(role: str, text: str) -> bytes:
    return f"{role}:{text}".encode("utf-8", "surrogatepass")


def key_of(conv_id: Column) -> Column:
    """A name for the conversation in which a null id is one as well."""
    return F.coalesce(F.concat(F.lit("i"), conv_id.cast("string")), F.lit(""))


def ordered(rows: DataFrame) -> DataFrame:
    """Rows dealt by ranges of conversation and place, so that a long conversation spreads over tasks."""
    named = rows.select(
        key_of(F.col("conv_id")).alias("c"), F.col("turn").isNotNull().cast("int").alias("has_turn"), F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("turn"),
        F.col("role").isNotNull().cast("int").alias("has_role"), F.coalesce("role", F.lit("")).alias("role"), F.md5(F.coalesce(F.concat(F.lit("t"), "text"), F.lit(""))).alias("digest"), "text")
    place = ["c", "has_turn", "turn", "has_role", "role", "digest"]
    return named.repartitionByRange(*place).sortWithinPartitions(*place)


RESULT = "c string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, sha string"
PLACE = "has_turn int, turn bigint, has_role int, role string, digest string, piece bigint, at int"
OPEN = "text string, " + PLACE
TURNS = "turns array<struct<role:string,text:string>>"


def result_row(c: str, counts: dict, cost: int, audit: str, sha: str | None) -> tuple:
    return (c, gaps_of(counts), counts[BLANK_ROW], counts[DUPLICATE_ROW], counts[TRUNCATED_ROW], counts["illegal"], cost, audit, sha)


def best_end(stacks: Stacks, level: dict) -> tuple:
    return min(way for node, way in level.items() if stacks.accepts(node))


def first_pass(rows: DataFrame, piece_rows: int, with_turns: bool) -> DataFrame:
    """Repairs of conversations that lie whole in a task and a piece, and the rows, cut into pieces, of the others."""
    def run(frames):
        from pyspark import TaskContext

        stacks, base, pieces = Stacks(), TaskContext.get().partitionId() << 33, 0
        names = [f.split()[0] for f in (RESULT + ", " + OPEN).split(", ")]
        done, rest, held, at, first = [], [], [], 0, True

        def close(c: str, whole: bool) -> None:
            """Ends the piece held, which is a whole conversation or a part of one."""
            nonlocal held, pieces
            if whole:
                seen, shapes, marks = set(), [], []
                for r in held:
                    fault = own_fault(r.text)
                    if fault != BLANK_ROW and (r.has_role, r.role, r.digest) in seen:
                        fault = DUPLICATE_ROW
                    seen.add((r.has_role, r.role, r.digest))
                    shapes.append(shape(r.role, fault))
                    marks.append((r.role, fault, r.turn if r.has_turn else None))
                cost, audit, turns = best_end(stacks, parse(stacks, 0, shapes))
                out = repaired([(r.role, r.text) for r in held], audit, turns)
                sha = hashlib.sha256(b"\n".join(turn_line(*x) for x in out)).hexdigest()
                done.append((*result_row(c, tally(marks), cost, audit, sha), *([None] * 8), [{"role": a, "text": b} for a, b in out] if with_turns else None))
            else:
                rest.extend((c, *([None] * 8), r.text, r.has_turn, r.turn, r.has_role, r.role, r.digest, base + pieces, k, None) for k, r in enumerate(held))
                pieces += 1
            held = []

        def flush():
            frame = pd.DataFrame(done + rest, columns=[*names, "turns"], dtype=object)
            done.clear()
            rest.clear()
            return frame

        current, parts = None, 0
        for frame in frames:
            for r in frame.itertuples(index=False):
                if r.c != current:
                    if current is not None:
                        close(current, not first and parts == 0)
                        first = False
                    current, parts = r.c, 0
                elif len(held) == piece_rows:
                    close(current, False)
                    parts += 1
                held.append(r)
            if len(done) + len(rest) >= 4096:
                yield flush()
        if current is not None:
            close(current, False)  # the next task may have more of it
        yield flush()

    return rows.mapInPandas(tidy(run), f"{RESULT}, {OPEN}, {TURNS}")


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` of open conversations with ``fault``; what came before is found by one aggregate over role and digest."""
    place = F.struct("has_turn", "turn", "has_role", "role", "digest", "piece", "at")
    keys = ["c", "has_role", "role", "digest"]
    first = rows.groupBy(*keys).agg(F.min(place).alias("first"))
    blank = F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    whole = ~F.coalesce(F.col("text").rlike(r"(?s)[.!?]" + BLANK_CLASS + r"*\z"), F.lit(False))
    fault = F.when(blank, BLANK_ROW).when(place != F.col("first"), DUPLICATE_ROW).when(whole, TRUNCATED_ROW).otherwise("")
    return rows.join(first, keys).withColumn("fault", fault).drop("first")


def outcomes(rows: DataFrame) -> DataFrame:
    """``c``, ``piece``, ``head`` (its first place) and ``outcome``: a piece's counts, and its repairs from every stack to every stack."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        stacks = Stacks()
        shapes = [shape(r, f) for r, f in zip(frame["role"], frame["fault"], strict=True)]
        counts = tally([(r, f, int(t) if h else None) for r, f, t, h in zip(frame["role"], frame["fault"], frame["turn"], frame["has_turn"], strict=True)])
        ways = {}
        for start in stacks.all_nodes():
            ways[stacks.names[start]] = {stacks.names[to]: way for to, way in parse(stacks, start, shapes).items()}
        row = {k: frame[k].iloc[0] for k in ("c", "piece", "has_turn", "turn", "has_role", "role", "digest")}
        return pd.DataFrame([{**row, "outcome": json.dumps([counts, ways])}])

    fields = ["c", "piece", "has_turn", "turn", "has_role", "role", "digest"]
    out = rows.select(*fields, "at", "fault").groupBy("c", "piece").applyInPandas(run, "c string, piece bigint, has_turn int, turn bigint, has_role int, role string, digest string, outcome string")
    return out


def joined_pieces(pieces: DataFrame) -> DataFrame:
    """A row of ``RESULT`` (``sha`` open) for each conversation, and ``parts``: number, piece, audit and turns of its pieces."""
    place = ["c", "has_turn", "turn", "has_role", "role", "digest", "piece"]

    def run(frames):
        stacks = Stacks()
        current, counts, level, numbers = None, None, {}, []

        def result() -> pd.DataFrame:
            cost, chain = None, None
            for node, (c, way) in level.items():
                if stacks.accepts(node) and (cost is None or c < cost or (c == cost and is_before(way, chain))):
                    cost, chain = c, way
            parts = []
            while chain is not None:
                parts.append(chain[1:])
                chain = chain[0]
            parts.reverse()
            listed = [{"number": k, "piece": p, "audit": a, "turns": t} for k, (p, (a, t)) in enumerate(zip(numbers, parts, strict=True))]
            row = (*result_row(current, counts, cost, "".join(a for a, _ in parts), None), listed)
            return pd.DataFrame([row], columns=[*[f.split()[0] for f in RESULT.split(", ")], "parts"], dtype=object)

        for frame in frames:
            for r in frame.itertuples(index=False):
                if r.c != current:
                    if current is not None:
                        yield result()
                    current, counts, level, numbers = r.c, None, {0: (0, None)}, []
                more, ways = json.loads(r.outcome)
                counts, new = added(counts, more), {}
                numbers.append(r.piece)
                for node, (cost, chain) in level.items():
                    for name, (c, audit, turns) in ways[stacks.names[node]].items():
                        to, total, link = stacks.named(name), cost + c, (chain, audit, turns)
                        if to not in new or total < new[to][0] or (total == new[to][0] and is_before(link, new[to][1])):
                            new[to] = (total, link)
                level = new
        if current is not None:
            yield result()

    parts = "parts array<struct<number:int,piece:bigint,audit:string,turns:string>>"
    return pieces.repartition("c").sortWithinPartitions(*place).mapInPandas(tidy(run), f"{RESULT}, {parts}")


def repaired_pieces(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """``c``, ``number``, ``at``, ``role``, ``text``: the repaired turns of open conversations."""
    chosen = joined.select("c", F.explode("parts").alias("p")).select("c", "p.*")

    def run(frame: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        frame, way = frame.sort_values("at"), chosen.iloc[0]
        turns = repaired(list(zip(frame["role"], frame["text"], strict=True)), way["audit"], way["turns"])
        return pd.DataFrame([(way["c"], way["number"], k, *x) for k, x in enumerate(turns)], columns=["c", "number", "at", "role", "text"], dtype=object)

    both = rows.select("c", "piece", "at", "role", "text").groupBy("c", "piece").cogroup(chosen.groupBy("c", "piece"))
    return both.applyInPandas(run, "c string, number int, at int, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """``c``, ``sha`` of the repaired turns; a task hashes them as they come, holding none of them."""
    def run(frames):
        current, digest = None, None
        for frame in frames:
            out = []
            for c, role, text in zip(frame["c"], frame["role"], frame["text"], strict=True):
                if c != current:
                    if current is not None:
                        out.append((current, digest.hexdigest()))
                    current, digest = c, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(turn_line(role, text))
            yield pd.DataFrame(out, columns=["c", "sha"], dtype=object)
        if current is not None:
            yield pd.DataFrame([(current, digest.hexdigest())], columns=["c", "sha"])

    return turns.repartition("c").sortWithinPartitions("c", "number", "at").mapInPandas(run, "c string, sha string")


class Repairs:
    """The repairs of all conversations: ``results`` a row for each, ``turns`` the repaired rows (``c``, ``number``, ``at``, ``role``, ``text``)."""

    def __init__(self, rows: DataFrame, piece_rows: int = PIECE, with_turns: bool = True):
        first = materialise(first_pass(ordered(rows), piece_rows, with_turns), "conversations")
        self.done = first.where("cost IS NOT NULL")
        open_ = first.where("cost IS NULL").select("c", *[f.split()[0] for f in OPEN.split(", ")])
        flagged = materialise(with_faults(open_), "open-rows")
        self.joined = materialise(joined_pieces(outcomes(flagged)), "joined")
        self.long = repaired_pieces(flagged, self.joined)

    @property
    def turns(self) -> DataFrame:
        short = self.done.select("c", F.posexplode("turns").alias("at", "t")).select("c", F.lit(0).alias("number"), "at", "t.role", "t.text")
        return short.unionByName(self.long)

    @property
    def results(self) -> DataFrame:
        names = [f.split()[0] for f in RESULT.split(", ")]
        long = self.joined.drop("sha").join(digests(self.long), "c", "left").withColumn("sha", F.coalesce("sha", F.sha2(F.lit(""), 256)))
        return self.done.select(*names).unionByName(long.select(*names))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` after the damage that the checksum of id and turn calls for."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    marked = rows.select("conv_id", "turn", "role", "text", kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return marked.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair_report(rows: DataFrame, piece_rows: int = PIECE) -> DataFrame:
    """One row per conversation of ``rows``: its faults, and the cost, audit and digest of its repair after damage."""
    found = Repairs(damaged(rows), piece_rows, with_turns=False).results
    ids = rows.groupBy("conv_id").agg(F.lit(1).alias("one")).select("conv_id", key_of(F.col("conv_id")).alias("c"))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return ids.join(found, "c", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def repair_sql() -> str:
    """The same report as DuckDB SQL: the least (cost, audit, turns) of each state of the role automaton, row after row."""
    edit = lambda q, cost, letter, turn="": f"{{'c': {q}.c + {cost}, 'a': {q}.a || '{letter}', 't': {q}.t{' || [' + turn + ']' if turn else ''}}}"
    none = "{'c': 1000000, 'a': '', 't': []::VARCHAR[]}"

    def read(q: str, role: str) -> str:
        keep = f"CASE WHEN d.initial = '{role[0]}' AND NOT d.must_go THEN {edit(q, 'd.extra', 'K', chr(34) + 'd' + chr(34) + '.role_text')} ELSE {none} END"
        rerole = f"CASE WHEN d.must_go THEN {none} ELSE {edit(q, f'{REROLE} + d.extra', 'R', chr(39) + role + ':' + chr(39) + ' || d.text')} END"
        return f"least({keep}, {rerole})"

    insert = lambda q, role: edit(q, INSERT, "I", f"'{role}:'")
    keep_s = f"CASE WHEN d.initial = 's' AND NOT d.must_go THEN {edit('r.q0', 'd.extra', 'K', 'd.role_text')} ELSE {none} END"
    inserted = lambda n2: f"least({n2}, {insert('n0', 'user')}, {insert('n1', 'user')}, {insert('n3', 'user')})"
    return f"""
    WITH RECURSIVE {crc32_sql("SELECT DISTINCT coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations")},
    marked AS (
        SELECT c.conv_id, c.turn, k.crc % 20 AS kind, CASE WHEN k.crc % 20 = 4 THEN 'user' ELSE c.role END AS role,
               CASE k.crc % 20 WHEN 1 THEN '' WHEN 2 THEN regexp_replace(c.text, '[.!?]', '', 'g') ELSE c.text END AS text
        FROM conversations c JOIN checksums k ON k.s = coalesce(c.conv_id::VARCHAR, ' ') || ':' || coalesce(c.turn::VARCHAR, ' ')),
    hurt AS (SELECT conv_id, turn, role, text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM marked),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
               NOT regexp_matches(coalesce(text, ''), '[^\x20\x09-\x0D]') AS is_blank, coalesce(left(role, 1), '') AS initial
        FROM hurt),
    judged AS (
        SELECT *, NOT is_blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS is_dup,
               NOT is_blank AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS is_cut,
               lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair
        FROM placed),
    rows AS (
        SELECT conv_id, pos, initial, text, coalesce(role, '') || ':' || coalesce(text, '') AS role_text, is_blank OR is_dup AS must_go,
               CASE WHEN is_cut AND NOT is_dup THEN {TRUNCATED} ELSE 0 END AS extra
        FROM judged),
    counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_dup) AS duplicate,
               count(*) FILTER (is_cut AND NOT is_dup) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
        FROM judged GROUP BY conv_id),
    ways AS (
        SELECT conv_id, 0::BIGINT AS pos, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS q0, {none} AS q1, {{'c': {INSERT}, 'a': 'I', 't': ['user:']}} AS q2,
               {{'c': {2 * INSERT}, 'a': 'II', 't': ['user:', 'assistant:']}} AS q3
        FROM counts
        UNION ALL
        SELECT conv_id, pos, n0, n1, n2, least(n3, {insert('n2', 'assistant')}) FROM (
            SELECT conv_id, pos, n0, n1, {inserted('m2')} AS n2, n3 FROM (
                SELECT d.conv_id, d.pos, {edit('r.q0', DELETE, 'D')} AS n0, least({edit('r.q1', DELETE, 'D')}, {keep_s}) AS n1,
                       least({edit('r.q2', DELETE, 'D')}, {read('r.q0', 'user')}, {read('r.q1', 'user')}, {read('r.q3', 'user')}) AS m2,
                       least({edit('r.q3', DELETE, 'D')}, {read('r.q2', 'assistant')}) AS n3
                FROM ways r JOIN rows d ON d.conv_id IS NOT DISTINCT FROM r.conv_id AND d.pos = r.pos + 1))),
    ends AS (SELECT w.conv_id, least(w.q0, w.q3) AS best FROM ways w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.pos)
    SELECT i.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
           coalesce(c.illegal, 0) AS illegal, coalesce(e.best.c, 0)::BIGINT AS cost, coalesce(e.best.a, '') AS audit,
           sha256(coalesce(array_to_string(e.best.t, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) i
    LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM i.conv_id
    """
