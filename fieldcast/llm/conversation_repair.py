"""Cheapest repair of a conversation's turn structure, by the auction algorithm for shortest paths.

The nodes of a conversation's lattice are (rows read, role said last). Reading a row keeps,
reroles or deletes it; an insertion moves between roles without reading. All arcs cost
integers, none is free to run in a circle. Every node carries a price that never exceeds
its distance to the end. A path grows from the start along an arc whose cost is the
difference of the prices; a node with no such arc raises its price to the cheapest arc's
and is taken off the path again. The path that arrives is a shortest one, and as the arcs
that are tight are tried in the order of their letters it is the first one in that order.

Rows are dealt by range over (conversation, turn, role, digest), so a conversation that
holds a third of all rows lies in many tasks. Each task cuts its piece of a conversation
into blocks of bounded size. Conversations within one task are finished there. For the
others a block gives the cost of each way in and out; these small tables are streamed from
the last block to the first for the prices at the seams, then from the first to the last
for the role each block starts with, and every block is repaired on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast.llm.rows import SPACE
from fieldcast.session import settle

#: Cost of each edit; a truncated row that stays costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows and characters of a block, rows between two exact price columns.
BLOCK_ROWS, BLOCK_CHARS, STRETCH = 4096, 4 << 20, 12
#: What may be said after nothing, a system row, a user row and an assistant row, by initial, and the state after it.
SAYS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that an edit gives in each state, and the state after it.
GIVES = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
#: Prices and insertions at a conversation's end: an opening needs its user, a user row its answer.
END_PRICES, END_INSERTS = (0, 2 * INSERT, INSERT, 0), (0, 2, 1, 0)
#: Beyond any difference that two states can make for the rest of a conversation (at most two insertions and a deletion).
FAR = 64
LEGAL = {"su", "ua", "au"}


def _arcs(kind: str, copies: int) -> list[list[tuple[str, int, int, int]]]:
    """For each state the arcs of a row, in the order of their letters: letter, cost, rows read, state after."""
    extra = TRUNCATED if kind.isupper() else 0
    out = []
    for state in range(4):
        after = GIVES[state][1]
        arcs = [("D", DELETE * copies, 1, state), ("I", INSERT, 0, after)]
        if kind != "d":
            if kind.lower() in SAYS[state]:
                arcs.append(("K", extra, 1, SAYS[state][kind.lower()]))
            arcs.append(("R", REROLE + extra, 1, after))
        out.append(arcs)
    return out


@lru_cache(1 << 16)
def _auction(rows: tuple[tuple[str, int], ...], ends: tuple[int, ...]) -> tuple[tuple[int, tuple[str, ...], int], ...]:
    """For each state at the start: cost to the end, letters of each row, state at the end.

    `ends` are the exact distances from there on. `rows` are (kind, copies); kind d must go.
    """
    arcs, n = [_arcs(*row) for row in rows], len(rows)
    least = [min(ends)] * n + [0]
    for i in reversed(range(n)):
        least[i] = min(a[1] for a in arcs[i][0] + arcs[i][2] if a[2]) + (least[i + 1] if i + 1 < n else min(ends))
    price = [[low] * 4 for low in least[:n]] + [list(ends)]
    out = []
    for origin in range(4):
        path, letters = [(0, origin)], []
        while path[-1][0] < n:
            i, state = path[-1]
            cost, letter, read, after = min((a[1] + price[i + a[2]][a[3]], a[0], a[2], a[3]) for a in arcs[i][state])
            if cost > price[i][state]:
                price[i][state] = cost
                if letters:
                    path.pop(), letters.pop()
            else:
                path.append((i + read, after))
                letters.append((letter, i))
        said = [""] * n
        for letter, i in letters:
            said[i] += letter * (rows[i][1] if letter == "D" else 1)
        out.append((price[0][origin], tuple(said), path[-1][1]))
    return tuple(out)


def sweep(rows: list[tuple[str, int]], ends: tuple[int, ...] = END_PRICES, stretch: int = STRETCH) -> tuple[tuple[int, ...], list]:
    """Distances from each state before the first row, and the routes of the stretches from the first to the last.

    From the last stretch to the first: the distances found at the start of one are the end prices of the one before it.
    """
    routes, prices = [], tuple(ends)
    for at in reversed(range(0, len(rows), stretch)):
        low = min(prices)
        solved = _auction(tuple(rows[at : at + stretch]), tuple(p - low for p in prices))
        prices = tuple(s[0] + low for s in solved)
        routes.append(solved)
    return prices, routes[::-1]


def follow(routes: list, state: int) -> tuple[list[str], int]:
    """Letters of each row on the way from a state, and the state after the last row."""
    letters = []
    for solved in routes:
        _, said, state = solved[state]
        letters += said
    return letters, state


def lines(letters: list[str], roles: list[str], texts: list[str], state: int, close: bool) -> tuple[str, list[str]]:
    """The audit and the repaired `role:text` lines of rows edited by these letters."""
    audit, out = "".join(letters), []
    for said, role, text in zip(letters, roles, texts):
        for letter in said.rstrip("D"):
            given, after = GIVES[state]
            if letter == "K":
                out.append(f"{role}:{text}")
                state = SAYS[state][role[0]]
            else:
                out.append(f"{given}:" if letter == "I" else f"{given}:{text}")
                state = after
    if close:
        audit += "I" * END_INSERTS[state]
        for _ in range(END_INSERTS[state]):
            given, state = GIVES[state]
            out.append(f"{given}:")
    return audit, out


class _Block:
    """Rows of one conversation that one task holds, up to the bounds."""

    def __init__(self, conv, number: int):
        self.conv, self.number, self.rows, self.roles, self.texts = conv, number, [], [], []
        self.chars = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.first_turn = self.last_turn = None

    def add(self, turn, role: str, text: str | None, kind: str, n: int, first: bool) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn, self.last_turn = turn if self.first_turn is None else self.first_turn, turn
        initial = role[:1]
        self.illegal += (self.last is not None and self.last + initial not in LEGAL) + n - 1
        self.first, self.last = initial if self.first is None else self.first, initial
        stays = 0
        if kind == "d":
            self.blank += n
        elif not first:
            self.duplicate += n
        else:
            self.duplicate += n - 1
            self.truncated += kind.isupper()
            self.rows.append((kind, 1))
            self.roles.append(role)
            self.texts.append(text)
            self.chars += len(text)
            stays = 1
        if n > stays:
            self.rows.append(("d", n - stays))
            self.roles.append("")
            self.texts.append("")

    def full(self, block_rows: int) -> bool:
        return len(self.rows) >= block_rows or self.chars >= BLOCK_CHARS

    def gaps(self) -> int:
        return self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0


def _part(conv: pa.DataType) -> pa.Schema:
    return pa.schema([("conv_id", conv), ("piece", pa.int64()), ("block", pa.int64()), ("edge", pa.bool_())] + [(c, pa.int64()) for c in COUNTS]
        + [("audit", pa.string()), ("repaired", pa.string()), ("first", pa.string()), ("last", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
           ("kinds", pa.list_(pa.string())), ("copies", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_PART_TYPES = "piece long, block long, edge boolean, " + ", ".join(f"{c} long" for c in COUNTS) + """, audit string, repaired string, first string, last string,
    first_turn long, last_turn long, kinds array<string>, copies array<long>, roles array<string>, texts array<string>"""


def _typed(conv: T.DataType, rest: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv), *T.StructType.fromDDL(rest).fields])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _batches(records: Iterator[dict], schema: pa.Schema, chars: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for record in records:
        held.append(record)
        size += 200 + sum(len(v) for v in record.values() if isinstance(v, str)) + sum(map(len, record.get("texts") or ()))
        if size >= chars:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _pieces(ordered: DataFrame, conv: T.DataType, block_rows: int, stretch: int) -> DataFrame:
    """Blocks of the ordered rows. A conversation that cannot reach into another task is repaired at once; the others are marked as edges."""
    schema = _part(pa.string() if isinstance(conv, T.StringType) else pa.int64())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Block, bool]]:
        piece, block, seen, number = 0, None, (), 0
        for conv_id, turn, role, digest, mark, text, kind, n, piece in _rows(batches):
            if block is None or conv_id != block.conv:
                if block is not None:
                    yield piece, block, True
                block, number = _Block(conv_id, number + 1), number + 1
            if mark == 1:
                seen = (turn, role, digest)
            elif mark == 2:
                if block.full(block_rows):
                    yield piece, block, False
                    block, number = _Block(conv_id, number + 1), number + 1
                block.add(turn, role, text, kind, n, seen == (turn, role, digest))
                seen = ()
        if block is not None:
            yield piece, block, True

    def record(piece: int, block: _Block, edge: bool) -> dict:
        out = {"conv_id": block.conv, "piece": piece, "block": block.number, "edge": edge, "gaps": block.gaps(), "blank": block.blank, "duplicate": block.duplicate,
               "truncated": block.truncated, "illegal": block.illegal}
        if edge:
            return out | {"first": block.first, "last": block.last, "first_turn": block.first_turn, "last_turn": block.last_turn, "kinds": [k for k, _ in block.rows],
                          "copies": [n for _, n in block.rows], "roles": block.roles, "texts": block.texts}
        prices, routes = sweep(block.rows, stretch=stretch)
        audit, said = lines(follow(routes, 0)[0], block.roles, block.texts, 0, True)
        return out | {"cost": prices[0], "audit": audit, "repaired": "\n".join(said) if said else None}

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, first, split = None, True, False
        for piece, block, whole in blocks(batches):
            if held is not None:
                yield record(*held)
            held = (piece, block, first or split or not whole)
            first, split = first and not whole, not whole
        if held is not None:
            yield record(held[0], held[1], True)

    return ordered.mapInArrow(lambda batches: _batches(records(batches), schema), _typed(conv, _PART_TYPES))


def _seams(edges: DataFrame, conv: T.DataType, stretch: int) -> DataFrame:
    """For each block of a conversation in several blocks: the state before it, the prices after it, whether it is the last, and what the seam before it adds."""
    key, native = "conv_id", pa.string() if isinstance(conv, T.StringType) else pa.int64()
    rest = "piece long, block long, kinds array<string>, copies array<long>, first string, last string, first_turn long, last_turn long"
    slim = edges.select(key, "piece", "block", "kinds", "copies", "first", "last", "first_turn", "last_turn")
    base = [(key, native), ("piece", pa.int64()), ("block", pa.int64()), ("kinds", pa.list_(pa.string())), ("copies", pa.list_(pa.int64())), ("first", pa.string()),
            ("last", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64())]
    names = [name for name, _ in base]

    def crossings(batches):
        for row in _rows(batches):
            record = dict(zip(names, row))
            rows = list(zip(record["kinds"], record["copies"]))
            columns = [sweep(rows, tuple(0 if k == out else FAR for k in range(4)), stretch)[0] for out in range(4)]
            yield record | {"table": [columns[out][into] for into in range(4) for out in range(4)]}

    def backwards(batches):
        conv_id, prices, begun = None, END_PRICES, False
        for row in _rows(batches):
            record = dict(zip([*names, "table"], row))
            last = not begun or record[key] != conv_id
            conv_id, begun = record[key], True
            prices = END_PRICES if last else prices
            table = record.pop("table")
            yield record | {"prices": list(prices), "is_last": last}
            prices = tuple(min(table[4 * into + out] + prices[out] for out in range(4)) for into in range(4))

    def exits(batches):
        for row in _rows(batches):
            record = dict(zip([*names, "prices", "is_last"], row))
            routes = sweep(list(zip(record.pop("kinds"), record.pop("copies"))), tuple(record["prices"]), stretch)[1]
            yield record | {"exits": [follow(routes, state)[1] for state in range(4)]}

    def forwards(batches):
        conv_id, state, begun, last, turn = None, 0, False, None, None
        for row in _rows(batches):
            record = dict(zip([name for name in names if name not in ("kinds", "copies")] + ["prices", "is_last", "exits"], row))
            if not begun or record[key] != conv_id:
                conv_id, state, begun, last, turn = record[key], 0, True, None, None
            gap = record["first_turn"] - turn - 1 if turn is not None and record["first_turn"] is not None else 0
            illegal = last is not None and record["first"] is not None and last + record["first"] not in LEGAL
            # The turn before may go on behind the seam: it is then counted twice, and -1 takes it back.
            yield {c: record[c] for c in ("piece", "block", "prices", "is_last")} | {"state": state, "seam_gaps": gap + (gap == -1), "seam_illegal": int(illegal)}
            state = record["exits"][state]
            last = record["last"] if record["last"] is not None else last
            turn = record["last_turn"] if record["last_turn"] is not None else turn

    def run(df: DataFrame, step, types: str, arrow: list) -> DataFrame:
        schema = pa.schema(arrow)
        return df.mapInArrow(lambda batches: _batches(step(batches), schema), types)

    spark_base = f"{key} {conv.simpleString()}, {rest}"
    few = [b for b in base if b[0] not in ("kinds", "copies")]
    prices, table = ("prices", pa.list_(pa.int64())), ("table", pa.list_(pa.int64()))
    crossed = run(slim, crossings, f"{spark_base}, table array<long>", [*base, table])
    priced = run(crossed.repartition(key).sortWithinPartitions(key, F.desc("piece"), F.desc("block")), backwards, f"{spark_base}, prices array<long>, is_last boolean",
                 [*base, prices, ("is_last", pa.bool_())])
    left = run(priced.repartition("piece", "block"), exits, f"{key} {conv.simpleString()}, piece long, block long, first string, last string, first_turn long, last_turn long, prices array<long>, is_last boolean, exits array<long>",
               [*few, prices, ("is_last", pa.bool_()), ("exits", pa.list_(pa.int64()))])
    return run(left.repartition(key).sortWithinPartitions(key, "piece", "block"), forwards, "piece long, block long, prices array<long>, is_last boolean, state long, seam_gaps long, seam_illegal long",
               [("piece", pa.int64()), ("block", pa.int64()), prices, ("is_last", pa.bool_()), ("state", pa.int64()), ("seam_gaps", pa.int64()), ("seam_illegal", pa.int64())])


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with the faults that a checksum of conversation and turn deals out; dropped ones keep no role and no text but are there, marked.

    A null role or text counts as one space, as does a null id or turn in the checksum.
    """
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    deal = F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn))) % 20
    body = F.when(deal == 1, "").when(deal == 2, F.regexp_replace(spaced(text), "[.!?]", "")).otherwise(spaced(text))
    return rows.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.when(deal == 4, "user").otherwise(spaced(role)).alias("role"), body.alias("text"),
        F.when(deal == 0, 0).when(deal == 3, 2).otherwise(1).cast("bigint").alias("n"),
    )


def _kind() -> Column:
    """The initial of a row's role (x where it is none of s, u, a), in capitals where its text ends without a mark; d for a blank text."""
    end = F.right(F.rtrim("text", F.lit(" \t\n\v\f\r")), F.lit(1))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return F.when(~F.col("text").rlike(SPACE.replace("[", "[^")), "d").when(end.isin(".", "!", "?"), known).otherwise(F.upper(known))


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, stretch: int = STRETCH) -> DataFrame:
    """Repaired conversations, in parts: conv_id, part, parts_follow, counts, cost, audit and repaired text of the part.

    `rows` has conv_id, turn, role, text and n, the number of times the row stands there (0: the
    conversation is known, the row is not). Rows are read by turn, nulls first, within a turn by role
    and MD5 of the text. A conversation has one part, or several if it reaches over tasks or past a
    block; counts and costs of its parts add up, audits and texts (null: no rows left) follow each
    other by part. Rows that are alike are counted once and stand n times; an empty table gives no
    parts; a conversation whose rows are all gone has one empty part; a null id is a conversation of
    its own; other columns are not looked at. A role that is empty or begins otherwise can only be
    reroled or deleted.
    """
    kind = rows.schema["conv_id"].dataType
    if not isinstance(kind, T.StringType):
        kind, rows = T.LongType(), rows.withColumn("conv_id", F.col("conv_id").cast("bigint"))
    alive = rows.where("n > 0")
    digest = F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("digest")
    nothing = [F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("kind"), F.lit(0).cast("bigint").alias("n")]
    heads = rows.select("conv_id").distinct().select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("mark"), *nothing)
    firsts = alive.groupBy("conv_id", "role", digest).agg(F.min(F.struct("turn")).alias("at")).select("conv_id", "at.turn", "role", "digest", F.lit(1).alias("mark"), *nothing)
    texts = alive.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).select("conv_id", "turn", "role", digest, F.lit(2).alias("mark"), "text", _kind().alias("kind"), "n")
    order = ["conv_id", "turn", "role", "digest"]
    ordered = texts.unionByName(firsts).unionByName(heads).repartitionByRange(*order).sortWithinPartitions(*order, "mark").withColumn("piece", F.spark_partition_id().cast("bigint"))
    pieces = settle(_pieces(ordered, kind, block_rows, stretch))
    keep = ["conv_id", "piece", "block"]
    done = pieces.where("not edge").select("conv_id", F.lit(0).cast("bigint").alias("part"), F.lit(True).alias("alone"), *COUNTS, "audit", "repaired")
    edges = pieces.where("edge")
    schema = pa.schema([("conv_id", pa.string() if isinstance(kind, T.StringType) else pa.int64()), ("part", pa.int64()), ("alone", pa.bool_())] + [(c, pa.int64()) for c in COUNTS] + [("audit", pa.string()), ("repaired", pa.string())])

    def finish(batches):
        for conv_id, piece, block, gaps, blank, duplicate, truncated, illegal, kinds, copies, roles, texts_, prices, last, state in _rows(batches):
            before, routes = sweep(list(zip(kinds, copies)), tuple(prices), stretch)
            letters, out = follow(routes, state)
            audit, said = lines(letters, roles, texts_, state, last)
            cost = before[state] - (0 if last else prices[out])
            yield {"conv_id": conv_id, "part": (piece << 32) + block, "alone": False, "gaps": gaps, "blank": blank, "duplicate": duplicate, "truncated": truncated,
                   "illegal": illegal, "cost": cost, "audit": audit, "repaired": "\n".join(said) if said else None}

    met = edges.join(_seams(edges, kind, stretch), ["piece", "block"]).select(
        *keep, (F.col("gaps") + F.col("seam_gaps")).alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + F.col("seam_illegal")).alias("illegal"), "kinds", "copies", "roles", "texts",
        "prices", "is_last", "state",
    )
    types = "part long, alone boolean, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired string"
    return done.unionByName(met.mapInArrow(lambda batches: _batches(finish(batches), schema), _typed(kind, types)))


def digests(parts: DataFrame) -> DataFrame:
    """One row for each conversation: its counts, whole audit and SHA-256 of its whole repaired text.

    Parts of one conversation are streamed in their order, so its text is never held whole.
    """
    kind = parts.schema["conv_id"].dataType
    parts = settle(parts)
    schema = pa.schema([("conv_id", pa.string() if isinstance(kind, T.StringType) else pa.int64())] + [(c, pa.int64()) for c in COUNTS] + [("audit", pa.string()), ("repaired_sha256", pa.string())])
    columns = ["conv_id", *COUNTS, "audit", "repaired"]

    def run(batches):
        def close():
            return {"conv_id": conv_id, **dict(zip(COUNTS, counts)), "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

        conv_id, counts, audit, digest, begun = None, None, [], None, False
        for row in _rows(batches):
            if counts is None or row[0] != conv_id:
                if counts is not None:
                    yield close()
                conv_id, counts, audit, digest, begun = row[0], [0] * len(COUNTS), [], hashlib.sha256(), False
            counts = [a + b for a, b in zip(counts, row[1:-2])]
            audit.append(row[-2])
            if row[-1] is not None:
                digest.update((b"\n" if begun else b"") + row[-1].encode())
                begun = True
        if counts is not None:
            yield close()

    types = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
    several = parts.where("not alone").repartition("conv_id").sortWithinPartitions("conv_id", "part").select(*columns)
    single = parts.where("alone").select("conv_id", *COUNTS, "audit", F.sha2(F.encode(F.coalesce("repaired", F.lit("")), "UTF-8"), 256).alias("repaired_sha256"))
    return single.unionByName(several.mapInArrow(lambda batches: _batches(run(batches), schema), _typed(kind, types)))
