"""Conversation structure repair by shortest paths over an edit lattice.

A lattice node is a row's place and a state of the wanted order of roles
(``s?(ua)+`` or nothing).  Edges keep a row (0), give it another role (2),
delete it (3) or insert an empty row (2); a truncated row that stays adds 1,
blank and duplicate rows must go.  Two Dijkstra searches, one from the start
and one from the end, run until no unmet pair of heap tops can be as cheap as
the best meeting; all crossings of that cost are then finished and the one
whose concatenated edits come first in ASCII order wins.

A conversation is cut into runs of ``CHUNK`` rows.  Of a longer one, each run
is solved for every pair of states at its ends, on any executor, and a
vector of four states is carried over the runs.  Only the digest of the
repaired text, which SHA-256 forces into one sequence, streams a whole
conversation through one task, a batch at a time.

Rows: nulls in role and text count as one space, a null conversation is one of
its own, null turns come first.  Rows of equal turn are ordered by role, then by
the text's SHA-256; equal rows are interchangeable.  A role is known by its first
character; others (and empty roles) can't be kept.  Texts of any length are
classified in the JVM.  A conversation without rows needs no edit.  An empty
table has no conversations.  Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from tessera.llm import ranks, shared

#: Rows of a run that is solved as one lattice.
CHUNK = 256
KEEP, REROLE, DELETE, INSERT = "KRDI"
TRUNCATED_COST, REROLE_COST, DELETE_COST, INSERT_COST = 1, 2, 3, 2

#: States: nothing yet, after the system's row, after a user's, after an
#: assistant's; a conversation may end in the first and the last.
STATES = range(4)
ENDS = (0, 3)
_STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_ROLE = {"u": "user", "a": "assistant"}
_GIVEN = tuple({r: to for r, to in step.items() if r in _ROLE} for step in _STEP)
_BEFORE = tuple([(q, r) for q in STATES for r, to in _STEP[q].items() if to == state] for state in STATES)
_LEGAL = frozenset(("su", "ua", "au"))
#: A row's symbol: its role (x: another), of a truncated row in capitals, of one
#: that must go a digit.
_DIGITS = {"s": "0", "u": "1", "a": "2", "x": "3"}
_INITIAL = {**{r: r for r in "suax"}, **{r.upper(): r for r in "suax"}, **{d: r for r, d in _DIGITS.items()}}


def _out(symbols: str, i: int, q: int) -> Iterator[tuple[int, int, int, str]]:
    """Edges from a node: place and state reached, cost, edit."""
    for to in _GIVEN[q].values():
        yield i, to, INSERT_COST, INSERT
    if i < len(symbols):
        symbol = symbols[i]
        yield i + 1, q, DELETE_COST, DELETE
        if not symbol.isdigit():
            more = TRUNCATED_COST * symbol.isupper()
            to = _STEP[q].get(symbol.lower())
            if to is not None:
                yield i + 1, to, more, KEEP
            for to in _GIVEN[q].values():
                yield i + 1, to, more + REROLE_COST, REROLE


def _into(symbols: str, i: int, q: int) -> Iterator[tuple[int, int, int, str]]:
    """Edges to a node: place and state they come from, cost, edit."""
    before = _BEFORE[q]
    for at, role in before:
        if role in _ROLE:
            yield i, at, INSERT_COST, INSERT
    if i > 0:
        symbol = symbols[i - 1]
        yield i - 1, q, DELETE_COST, DELETE
        if not symbol.isdigit():
            more = TRUNCATED_COST * symbol.isupper()
            for at, role in before:
                if role == symbol.lower():
                    yield i - 1, at, more, KEEP
                if role in _ROLE:
                    yield i - 1, at, more + REROLE_COST, REROLE


def cheapest(symbols: str, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """Least cost, and the first audit of that cost, from a state before the
    rows to one of the states after them.

    At equal cost a heap gives nodes in the order of their places, so that
    edges of no cost are relaxed before what they lead to is settled: a settled
    node's audit is the first of its cost.  (Of two audits that lead to one
    node at one cost, none is the beginning of the other.)
    """
    n = len(symbols)
    sides = [{(0, start): (0, "")}, {(n, q): (0, "") for q in ends}]
    heaps = [[(0, 0, start)], [(0, -n, q) for q in sorted(ends)]]
    settled: list[dict] = [{}, {}]
    reach, best = [0, 0], None
    while heaps[0] or heaps[1]:
        top = [heap[0][0] if heap else reach[side] for side, heap in enumerate(heaps)]
        if len(settled[1]) < len(ends):  # the ends first: every path then has a crossing edge
            side = 1
        elif not settled[0]:
            side = 0
        elif best is not None and top[0] + top[1] > best:
            break
        else:
            side = 0 if heaps[0] and (not heaps[1] or top[0] <= top[1]) else 1
        cost, place, q = heappop(heaps[side])
        node = (abs(place), q)
        if node in settled[side]:
            continue
        labels, audit = sides[side], sides[side][node][1]
        settled[side][node] = (cost, audit)
        reach[side] = cost
        if (met := sides[1 - side].get(node)) is not None and (best is None or cost + met[0] < best):
            best = cost + met[0]
        for i, to, more, edit in (_into if side else _out)(symbols, *node):
            label = (cost + more, edit + audit if side else audit + edit)
            if (known := labels.get((i, to))) is None or label[0] < known[0]:
                labels[i, to] = label
                heappush(heaps[side], (label[0], -i if side else i, to))
            elif label < known:
                labels[i, to] = label
    if best is None:
        return None
    if not n and start in ends:
        return 0, ""
    first, audit = None, None
    for node, (cost, head) in settled[0].items():
        for i, to, more, edit in _out(symbols, *node):
            tail = settled[1].get((i, to))
            if tail is not None and cost + more + tail[0] == best:
                audit = head + edit + tail[1]
                first = audit if first is None or audit < first else first
    return best, first


def illegal_pairs(symbols: str) -> int:
    roles = "".join(_INITIAL[s] for s in symbols)
    return sum(roles[i:i + 2] not in _LEGAL for i in range(len(roles) - 1))


def _before(a: tuple, b: tuple) -> bool:
    """Whether chain ``a`` of audits comes first: chains (chain before, audit)
    of as many runs, compared from where they part."""
    left, right = [], []
    while a is not b:
        left.append(a[1])
        right.append(b[1])
        a, b = a[0], b[0]
    return "".join(reversed(left)) < "".join(reversed(right))


def _carried(vector: dict, costs: list, audits: list) -> dict:
    """The states' least costs and audits after one more run."""
    out: dict = {}
    for q, (cost, chain) in vector.items():
        for to in STATES:
            if costs[4 * q + to] < 0:
                continue
            total, made = cost + costs[4 * q + to], (chain, audits[4 * q + to])
            if to not in out or total < out[to][0] or total == out[to][0] and _before(made, out[to][1]):
                out[to] = (total, made)
    return out


def _joined(chain: tuple | None) -> str:
    parts = []
    while chain is not None:
        parts.append(chain[1])
        chain = chain[0]
    return "".join(reversed(parts))


def _symbols(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (conv, turn, role, digest, copy, letter, fault) with place and
    symbol, and each conversation's counts."""
    placed = shared.written(ranks.ranked(shared.written(rows, "rows"), "conv", ["turn", "role", "digest", "copy"]), "placed")
    repeated = (placed.filter("fault <> 'blank'").groupBy("conv", "role", "digest")
                .agg(F.min("rank").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    faults = (placed.join(repeated, ["conv", "role", "digest"], "left")
              .withColumn("fault", F.expr("IF(fault <> 'blank' AND rank > first, 'duplicate', fault)")))
    symbol = F.expr("CASE WHEN fault IN ('blank', 'duplicate') THEN translate(letter, 'suax', '0123') "
                    "WHEN fault = 'truncated' THEN upper(letter) ELSE letter END")
    coded = shared.written(faults.select("conv", "turn", "rank", "fault", symbol.alias("symbol")), "symbols")
    counts = coded.groupBy("conv").agg(
        F.expr("coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)").alias("gaps"),
        *(F.expr(f"count_if(fault = '{name}')").alias(name) for name in ("blank", "duplicate", "truncated")))
    return coded, counts


def _solved(coded: DataFrame) -> DataFrame:
    """Costs and audits of every run: of a conversation's only run (which is not
    full) one of each, else one for each pair of states."""
    runs = (coded.groupBy("conv", (F.col("rank") / CHUNK).cast("long").alias("chunk"))
            .agg(F.expr("array_join(transform(array_sort(collect_list(struct(rank, symbol))), x -> x.symbol), '')").alias("symbols")))
    schema = _parse_datatype_string("conv string, chunk long, illegal long, first string, last string, costs array<long>, audits array<string>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, known = to_arrow_schema(schema), {}
        for batch in batches:
            out = []
            for conv, chunk, symbols in zip(*(batch.column(c).to_pylist() for c in ("conv", "chunk", "symbols")), strict=True):
                only = chunk == 0 and len(symbols) < CHUNK
                if (found := known.get((symbols, only))) is None:
                    pairs = [(0, ENDS)] if only else [(q, (to,)) for q in STATES for to in STATES]
                    made = [cheapest(symbols, *pair) or (-1, "") for pair in pairs]
                    found = (illegal_pairs(symbols), [m[0] for m in made], [m[1] for m in made])
                    if len(known) > 20_000:  # at most so many, of at most 16 audits of a run each
                        known.clear()
                    if only and len(symbols) < 32:
                        known[symbols, only] = found
                out.append((conv, chunk, found[0], _INITIAL[symbols[0]], _INITIAL[symbols[-1]], found[1], found[2]))
            yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)]
                                  if out else [pa.array([], type=f.type) for f in arrow], schema=arrow)

    return shared.map_arrow(runs, run, schema)


def _composed(solved: DataFrame) -> DataFrame:
    """``conv``, ``illegal``, ``cost`` and ``audit`` of every conversation."""
    schema = _parse_datatype_string("conv string, illegal long, cost long, audit string")
    dealt = solved.repartition("conv").sortWithinPartitions("conv", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, current = to_arrow_schema(schema), None
        vector, illegal, last, only = {}, 0, None, None

        def closed() -> tuple:
            if only is not None:
                return current, illegal, *only
            end = None
            for q in ENDS:
                if q in vector and (end is None or vector[q][0] < end[0] or vector[q][0] == end[0] and _joined(vector[q][1]) < _joined(end[1])):
                    end = vector[q]
            return current, illegal, end[0], _joined(end[1])

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["conv"] != current:
                    if current is not None:
                        out.append(closed())
                    current, vector, illegal, last, only = row["conv"], {0: (0, None)}, 0, None, None
                illegal += row["illegal"] + (last is not None and last + row["first"] not in _LEGAL)
                last = row["last"]
                if len(row["costs"]) == 1:
                    only = row["costs"][0], row["audits"][0]
                else:
                    vector = _carried(vector, row["costs"], row["audits"])
            if out:
                yield table(out)
        if current is not None:
            yield table([closed()])

    return shared.map_arrow(dealt, run, schema)


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """``role:text`` of the repaired conversation's rows, from its edits and
    rows in order; takes one row at a time."""
    state, rows = 0, iter(rows)
    for edit in audit:
        if edit == INSERT:
            (role, state), = _GIVEN[state].items()
            yield f"{_ROLE[role]}:"
            continue
        role, text = next(rows)
        if edit == KEEP:
            state = _STEP[state][role[:1]]
            yield f"{role}:{text}"
        elif edit == REROLE:
            (given, state), = _GIVEN[state].items()
            yield f"{_ROLE[given]}:{text}"


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows ``conv`` (a string), ``turn``, ``role``, ``text`` and ``copy``
    (numbers equal rows): each conversation's counts, ``cost`` and ``audit``,
    and its rows with the edit digest ready to be joined by ``conv``."""
    # rtrim and the class below are the characters \x20 and \x09 to \x0D.
    body = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    letter = F.substring("role", 1, 1)
    fault = (F.when(body == "", "blank").when(F.right(body, F.lit(1)).isin(".", "!", "?"), "none").otherwise("truncated"))
    digested = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    narrow = digested.select("conv", "turn", "role", "digest", "copy",
                             F.when(letter.isin("s", "u", "a"), letter).otherwise("x").alias("letter"), fault.alias("fault"))
    coded, counts = _symbols(narrow)
    found = shared.written(_composed(_solved(coded)), "audits")
    return counts, _hashed(found, digested)


def _hashed(found: DataFrame, rows: DataFrame) -> DataFrame:
    """``repaired_sha256`` beside the audits: a conversation's audit, then its
    rows in order, stream through one task."""
    schema = StructType([*found.schema.fields, *_parse_datatype_string("repaired_sha256 string").fields])
    dealt = (found.withColumn("kind", F.lit(0))
             .unionByName(rows.select("conv", "turn", "role", "digest", "copy", "text").withColumn("kind", F.lit(1)), allowMissingColumns=True)
             .repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "digest", "copy").drop("digest", "copy", "turn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)

        def each() -> Iterator[dict]:
            for batch in batches:
                for part in shared.slices([batch]):
                    yield from part.to_pylist()

        stream, ahead = each(), None
        out: list[dict] = []
        ahead = next(stream, None)
        while ahead is not None:
            head = ahead
            following: list[dict] = []

            def texts() -> Iterator[tuple[str, str]]:
                for row in stream:
                    if row["kind"] == 0:
                        following.append(row)
                        return
                    yield row["role"], row["text"]

            sha, mark, own = hashlib.sha256(), b"", texts()
            for line in repaired(head["audit"], own):
                sha.update(mark + line.encode())
                mark = b"\n"
            for _ in own:  # none is left but the next head
                pass
            out.append({name: head[name] for name in found_names} | {"repaired_sha256": sha.hexdigest()})
            ahead = following[0] if following else None
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    found_names = found.columns
    return shared.map_arrow(dealt, run, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the contract's damage: dropped, emptied, without end
    marks, repeated or given to the user, by the checksum of their key."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    conv = F.coalesce(F.concat(F.lit("1"), F.col("conv_id").cast("string")), F.lit("0"))
    return (conversations.select(conv.alias("conv"), "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
                                 F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), kind.alias("kind"))
            .filter("kind <> 0").withColumn("copy", F.explode(F.expr("IF(kind = 3, array(0, 1), array(0))"))).drop("kind"))


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """Counts, cost, audit and digest of every original conversation."""
    every = (conversations.select("conv_id", F.coalesce(F.concat(F.lit("1"), F.col("conv_id").cast("string")), F.lit("0")).alias("conv"))
             .distinct())
    counts, found = repair(damaged(conversations))
    empty = hashlib.sha256(b"").hexdigest()
    return (every.join(counts, "conv", "left").join(found, "conv", "left")
            .select("conv_id", *(F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                    F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and its digest for every conversation."""
    return repair_conversations(shared.read_table(spark, sf_dir, "conversations"))
