"""Repair of conversations to an alternating structure by Wagner-Fischer alignment.

The turns of a conversation are aligned to every feasible length of the role string
``(s?(ua)+)?``. All lengths end alike, so one matrix of (turns left, roles left) serves them; cells
outside the Ukkonen band of the incumbent, a plain greedy repair, are never made. Of the lengths of
least cost the backtraced audits are compared. A conversation of more turns than ``LONG`` keeps
only the three phases that the roles left can be in, which gives the same in linear time.

Conversations pass through sorted partitions as a stream: a task holds one byte a turn and the
audit of the conversation at hand, never its texts.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galeframe.llm.common import column

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Turns above which the columns of the alignment are folded into phases.
LONG = 1000
BLANKS = " \t\n\x0b\x0c\r"
#: Rows and bytes of text that an Arrow batch of repaired turns holds at most, one longer turn aside.
ROWS, BYTES = 1000, 4 << 20
#: What a turn may be, as one letter: kept as s, u or a, or under another role; small if truncated; to be deleted.
LETTERS, GONE = {"s": "S", "u": "U", "a": "A"}, "X"
FAR = 1 << 40


def _costs(turn: str) -> tuple[int, int, int, int]:
    """Cost of keeping a turn as s, as u, as a, and what it costs more if it stays at all."""
    if turn == GONE:
        return FAR, FAR, FAR, FAR
    more = TRUNCATED if turn.islower() else 0
    u, a = (more + (KEEP if turn.upper() == own else REROLE) for own in "UA")
    return more + KEEP if turn.upper() == "S" else FAR, u, a, more


def _greedy(turns: str) -> int:
    """The cost of a repair in one pass: what is faulty goes, what is out of turn gets the role due."""
    cost, stay, last = 0, 0, 0
    for i, turn in enumerate(turns):
        if turn == GONE or turn.islower():
            cost += DELETE
        elif i or turn != "S":
            last = KEEP if turn == "UA"[stay % 2] else REROLE
            cost, stay = cost + last, stay + 1
    if stay % 2:
        cost, stay = cost + DELETE - last, stay - 1
    return min(cost, DELETE * len(turns)) if stay else DELETE * len(turns)


def _suffix_costs(turns: str, most: int) -> list[dict[int, int]]:
    """For every turn, by number of roles left, the cost of aligning what is left; none above ``most``."""
    n = len(turns)
    below = {q: INSERT * q for q in range(most // INSERT + 1)}
    rows = [below]
    for i in range(n - 1, -1, -1):
        left, row = n - i, {}
        _, u, a, _ = _costs(turns[i])
        for q in range(max(0, left - most // DELETE), left + most // INSERT + 1):
            best = below.get(q, FAR) + DELETE
            if q:
                best = min(best, row.get(q - 1, FAR) + INSERT, below.get(q - 1, FAR) + (a if q % 2 else u))
            if best <= most:
                row[q] = best
        rows.append(row)
        below = row
    rows.reverse()
    return rows


def _trace(turns: str, costs: list[dict[int, int]], i: int, q: int) -> str:
    """The ASCII-least edits of least cost from turn ``i`` with ``q`` roles left."""
    out, n = [], len(turns)
    while i < n or q:
        here = costs[i][q]
        if i < n and costs[i + 1].get(q, FAR) + DELETE == here:
            out.append("D")
            i += 1
        elif q and costs[i].get(q - 1, FAR) + INSERT == here:
            out.append("I")
            q -= 1
        else:
            _, _, _, more = _costs(turns[i])
            out.append("K" if costs[i + 1][q - 1] + more + KEEP == here and turns[i].upper() == "UA"[q % 2] else "R")
            i, q = i + 1, q - 1
    return "".join(out)


def align(turns: str) -> tuple[int, str]:
    """Least cost and audit, from one alignment for every feasible length of the role string."""
    most = _greedy(turns)
    costs = _suffix_costs(turns, most)
    found = [(cost, "", 0, q) for q, cost in costs[0].items() if q % 2 == 0]
    for i, turn in enumerate(turns):
        as_s = _costs(turn)[0]
        if as_s < FAR:
            found += [(DELETE * i + as_s + cost, "D" * i + "K", i + 1, q) for q, cost in costs[i + 1].items() if q and q % 2 == 0]
    least = min(f[0] for f in found)
    return least, min(start + _trace(turns, costs, i, q) for cost, start, i, q in found if cost == least)


def folded(turns: str) -> tuple[int, str]:
    """The same as ``align`` by phases: an even or odd number of roles left, or an even one above 0."""
    n = len(turns)
    even, odd, some = (array("q", [0]) * (n + 1) for _ in range(3))
    even[n], odd[n], some[n] = 0, INSERT, 2 * INSERT
    for i in range(n - 1, -1, -1):
        _, u, a, _ = _costs(turns[i])
        e, o = min(even[i + 1] + DELETE, odd[i + 1] + u), min(odd[i + 1] + DELETE, even[i + 1] + a)
        even[i], odd[i] = min(e, o + INSERT), min(o, e + INSERT)
        some[i] = min(some[i + 1] + DELETE, odd[i + 1] + u, odd[i] + INSERT)

    def trace(i, phase):
        out = bytearray()
        after = {id(even): odd, id(odd): even, id(some): odd}
        while i < n or phase is not even:
            here, then = phase[i], after[id(phase)]
            if i < n and phase[i + 1] + DELETE == here:
                out += b"D"
                i += 1
            elif then[i] + INSERT == here:
                out += b"I"
                phase = then
            else:
                own = turns[i].upper() == ("A" if phase is odd else "U")
                out += b"K" if own and then[i + 1] + _costs(turns[i])[3] + KEEP == here else b"R"
                i, phase = i + 1, then
        return out.decode()

    starts = [DELETE * i + _costs(t)[0] + some[i + 1] for i, t in enumerate(turns)]
    least = min([even[0], *starts])
    audits = [trace(0, even)] if even[0] == least else []
    # Of the starts with a system turn the last has most deletions before, which sort first.
    for i in [i for i, cost in enumerate(starts) if cost == least][-1:]:
        audits.append("D" * i + "K" + trace(i + 1, some))
    return least, min(audits)


def solve(turns: str) -> tuple[int, str]:
    return align(turns) if len(turns) <= LONG else folded(turns)


def faults(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(id, turn, role, text, print, letter, fault): the turns with their first fault.

    ``blank``: no character but white space; ``duplicate``: role and text stood earlier in the
    conversation; ``truncated``: the last character is none of ``.!?``. NULL roles and texts count as
    one blank, NULL turns come first; turns of one number follow by role and digest of the text.
    """
    blank = F.lit(" ")
    own = turns.select(
        turns[key].alias("id"), turns["turn"].alias("turn"),
        F.coalesce(turns["role"], blank).alias("role"), F.coalesce(turns["text"], blank).alias("text"),
    ).withColumn("print", F.sha2("text", 256))
    bare = F.rtrim("text", F.lit(BLANKS))
    seen = F.row_number().over(Window.partitionBy("id", "role", "print").orderBy("turn")) > 1
    marked = own.select(
        "id", "turn", "role", "print", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(*".!?")).alias("open")
    ).withColumn("seen", seen)
    fault = F.when(F.col("blank"), "blank").when(F.col("seen"), "duplicate").when(F.col("open"), "truncated")
    role = F.substring("role", 1, 1)
    kind = F.when(role == "s", "S").when(role == "u", "U").when(role == "a", "A").otherwise("O")
    letter = F.when(F.col("blank") | F.col("seen"), GONE).when(F.col("open"), F.lower(kind)).otherwise(kind)
    return marked.select("id", "turn", "role", "print", kind.alias("kind"), fault.alias("fault"), letter.alias("letter"))


def _streamed(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("id").sortWithinPartitions("id", *order)


def audits(turns: DataFrame, ids: DataFrame, key: str = "conv_id") -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit) for every id of ``ids``.

    ``gaps`` counts the turn numbers missing between the least and the largest, ``illegal`` the
    neighbours whose roles do not follow each other. Ids without turns have zeros and no audit.
    """
    kind = dict(turns.dtypes)[key]
    heads = ids.select(ids[key].alias("id")).distinct().select("id", F.lit(0).alias("row"), *_nulls(turn="long", print="string", role="string", kind="string", fault="string", letter="string"))
    own = faults(turns, key).select("id", F.lit(1).alias("row"), F.col("turn").cast("long").alias("turn"), "print", "role", "kind", "fault", "letter")
    columns = ["id", "row", "turn", "kind", "fault", "letter"]
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def run(batches):
        out = {c: [] for c in ("id", *counts, "audit")}
        state = None

        def close():
            if state is None:
                return
            cost, audit = solve(state["turns"].decode()) if state["turns"] else (0, "")
            gaps = state["last"] - state["first"] + 1 - state["distinct"] if state["distinct"] else 0
            values = (state["id"], gaps, state["blank"], state["duplicate"], state["truncated"], state["illegal"], cost, audit)
            for c, v in zip(out, values):
                out[c].append(v)

        def flush(schema):
            kinds = [schema, *[pa.int64()] * len(counts), pa.string()]
            made = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))
            for v in out.values():
                v.clear()
            return made

        schema, held = None, 0
        for batch in batches:
            schema = batch.schema.field(0).type
            for i, row, turn, role, fault, letter in zip(*[column(batch, c).to_pylist() for c in columns]):
                if row == 0:
                    close()
                    held += len(state["turns"]) + 100 if state else 0
                    if held > BYTES:
                        yield flush(schema)
                        held = 0
                    state = {"id": i, "turns": bytearray(), "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                    state |= {"first": None, "last": None, "distinct": 0, "role": None}
                    continue
                if fault:
                    state[fault] += 1
                if state["role"] is not None and state["role"] + role not in ("SU", "UA", "AU"):
                    state["illegal"] += 1
                state["role"] = role
                state["turns"] += letter.encode()
                if turn is not None and turn != state["last"]:
                    state["first"] = turn if state["first"] is None else state["first"]
                    state["last"] = turn
                    state["distinct"] += 1
        close()
        if out["id"]:
            yield flush(schema)

    rows = _streamed(heads.unionByName(own), "row", "turn", "role", "print").select(*columns)
    return rows.mapInArrow(run, f"id {kind}, {', '.join(f'{c} long' for c in counts)}, audit string")


def _nulls(**columns: str) -> list[Column]:
    return [F.lit(None).cast(k).alias(c) for c, k in columns.items()]


def repair(turns: DataFrame, ids: DataFrame, key: str = "conv_id") -> DataFrame:
    """(id, at, role, text, edit) in order: the repaired turns of every conversation from 1 on.

    Row 0 of a conversation has its audit as ``text`` and, in ``counts``, what ``audits`` counts. An
    empty table gives none; repeated rows are duplicates; an id without turns has row 0 alone.
    """
    kind = dict(turns.dtypes)[key]
    made = audits(turns, ids, key)
    counts = F.array("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    heads = made.select("id", F.lit(0).alias("row"), *_nulls(turn="long", print="string", role="string"), F.col("audit").alias("text"), counts.alias("counts"))
    blank = F.lit(" ")
    own = turns.select(turns[key].alias("id"), F.lit(1).alias("row"), turns["turn"].cast("long").alias("turn"), F.coalesce(turns["role"], blank).alias("role"), F.coalesce(turns["text"], blank).alias("text"), F.lit(None).cast("array<long>").alias("counts"))
    own = own.withColumn("print", F.sha2("text", 256))
    names = ["id", "at", "role", "text", "edit", "counts"]

    def run(batches):
        out, held = {c: [] for c in names}, 0
        now, audit, at, step, odd = None, "", 0, 0, False

        def add(*values):
            for c, v in zip(names, values):
                out[c].append(v)

        def inserted():
            nonlocal at, step, odd
            while audit[step : step + 1] == "I":
                step, at = step + 1, at + 1
                add(now, at, "assistant" if odd else "user", "", "I", None)
                odd = not odd

        def flush(kind):
            kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int64())]
            batch = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names)
            for v in out.values():
                v.clear()
            return batch

        schema = None
        for batch in batches:
            schema = batch.schema.field(0).type
            for i, row, role, text, counts in zip(*[column(batch, c).to_pylist() for c in ("id", "row", "role", "text", "counts")]):
                held += len(text)
                if row == 0:
                    inserted()
                    now, audit, at, step, odd = i, text, 0, 0, False
                    add(i, 0, None, audit, None, counts)
                else:
                    inserted()
                    edit, step = audit[step], step + 1
                    if edit != "D":
                        at += 1
                        due = "assistant" if odd else "user"
                        add(i, at, role if edit == "K" else due, text, edit, None)
                        odd = odd if at == 1 and edit == "K" and role[:1] == "s" else not odd
                if held > BYTES or len(out["id"]) >= ROWS:
                    yield flush(schema)
                    held = 0
        inserted()
        if out["id"]:
            yield flush(schema)

    rows = _streamed(heads.unionByName(own), "row", "turn", "role", "print").select("id", "row", "role", "text", "counts")
    return rows.mapInArrow(run, f"id {kind}, at long, role string, text string, edit string, counts array<long>")


def digests(repaired: DataFrame) -> DataFrame:
    """(id, counts, audit, sha): the SHA-256 of the ``role:text`` lines of what ``repair`` returned."""
    kind = dict(repaired.dtypes)["id"]

    def run(batches):
        out, state, schema = [[], [], [], []], None, None
        for batch in batches:
            schema = batch.schema.field(0).type
            for i, at, role, text, counts in zip(*[column(batch, c).to_pylist() for c in ("id", "at", "role", "text", "counts")]):
                if at == 0:
                    if state:
                        out[3].append(state.hexdigest())
                    if len(out[0]) >= ROWS:
                        yield pack(out, schema)
                    state = hashlib.sha256()
                    for held, v in zip(out, (i, counts, text)):
                        held.append(v)
                else:
                    state.update((("\n" if at > 1 else "") + f"{role}:{text}").encode())
        if state:
            out[3].append(state.hexdigest())
            yield pack(out, schema)

    def pack(out, schema):
        kinds = [schema, pa.list_(pa.int64()), pa.string(), pa.string()]
        made = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], ["id", "counts", "audit", "sha"])
        for v in out:
            v.clear()
        return made

    return repaired.mapInArrow(run, f"id {kind}, counts array<long>, audit string, sha string")


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` with one of five faults in a quarter of them, by the CRC-32 of ``conv_id:turn``."""
    blank = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(turns[c].cast("string"), blank) for c in ("conv_id", "turn")])
    own = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("d"))
    d = F.col("d")
    text = F.when(d == 1, "").when(d == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    hurt = own.filter(d != 0).select("conv_id", "turn", F.when(d == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "d")
    return hurt.withColumn("copy", F.explode(F.sequence(F.lit(0), (d == 3).cast("int")))).drop("d", "copy")


def oracle_sql(crc: str) -> str:
    """The query in DuckDB: states of the alignment as strings of cost and audit, of which the least is taken.

    ``crc`` is the text of the common tables ``crc(t)``, the table of CRC-32.
    """

    def add(x, cost, letter):
        return f"printf('%08d', substr({x}, 1, 8)::BIGINT + {cost}) || substr({x}, 9) || '{letter}'"

    far = "'90000000:'"
    more = f"CASE WHEN y.open THEN {TRUNCATED} ELSE 0 END"

    def due(x, own):
        kept = add(x, f"({more})", "K")
        return f"CASE WHEN y.gone THEN {far} WHEN y.kind = '{own}' THEN least({kept}, {add(x, f'1 + ({more})', 'R')}) ELSE {add(x, f'1 + ({more})', 'R')} END"

    def opened(x, inner):
        """The states after insertions before a turn, for ``inner`` that reads them as p.none, p.s, p.u, p.a."""
        u = f"least({x}.u, {add(f'{x}.none', INSERT, 'I')}, {add(f'{x}.s', INSERT, 'I')}, {add(f'{x}.a', INSERT, 'I')})"
        first = f"[{{'none': {x}.none, 's': {x}.s, 'u': {u}, 'a': {x}.a}}]"
        second = f"list_transform({first}, lambda q: {{'none': q.none, 's': q.s, 'u': q.u, 'a': least(q.a, {add('q.u', INSERT, 'I')})}})"
        return f"list_transform({second}, lambda p: {inner})[1]"

    step = f"""{{'gone': false, 'open': false, 'kind': '', 'none': {add('p.none', DELETE, 'D')},
      's': least({add('p.s', DELETE, 'D')}, CASE WHEN y.kind = 's' AND NOT y.gone THEN {add('p.none', f'({more})', 'K')} ELSE {far} END),
      'u': least({add('p.u', DELETE, 'D')}, {due('least(p.none, p.s, p.a)', 'u')}),
      'a': least({add('p.a', DELETE, 'D')}, {due('p.u', 'a')})}}"""
    begin = f"{{'gone': false, 'open': false, 'kind': '', 'none': '00000000:', 's': {far}, 'u': {far}, 'a': {far}}}"
    turn = f"{{'gone': gone, 'open': open, 'kind': kind, 'none': {far}, 's': {far}, 'u': {far}, 'a': {far}}}"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE {crc}, told AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), hashed AS (
  SELECT *, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(name)), '..'), lambda p: ('0x' || p)::BIGINT)),
    lambda a, v: xor(a // 256, t[xor(a % 256, v) + 1]))) % 20 AS d FROM told, crc
), hurt AS (
  SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE d <> 0
), placed AS (
  SELECT *, substr(role, 1, 1) AS kind, rtrim(text, {blanks}) AS bare,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM hurt
), marked AS (
  SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
    lag(kind) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), judged AS (
  SELECT *, blank OR seen AS gone, NOT blank AND NOT seen AND right(bare, 1) NOT IN ('.', '!', '?') AS open FROM marked
), packed AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (seen) AS duplicate, count(*) FILTER (open) AS truncated,
    count(*) FILTER (i > 1 AND before || kind NOT IN ('su', 'ua', 'au')) AS illegal,
    list({turn} ORDER BY i) AS turns, list(role ORDER BY i) AS roles, list(text ORDER BY i) AS texts FROM judged GROUP BY conv_id
), reduced AS (
  SELECT *, list_reduce(list_prepend({begin}, turns), lambda x, y: {opened('x', step)}) AS x FROM packed
), solved AS (
  SELECT *, {opened('x', "least(p.none, p.a)")} AS best FROM reduced
), audited AS (
  SELECT * EXCLUDE (turns, x, best), substr(best, 1, 8)::BIGINT AS cost, substr(best, 10) AS audit FROM solved
), edits AS (
  SELECT conv_id, unnest(range(1, len(audit) + 1)) AS e, audit, roles, texts FROM audited
), lettered AS (
  SELECT conv_id, e, substr(audit, e, 1) AS edit, len(replace(substr(audit, 1, e), 'I', '')) AS place, roles, texts FROM edits
), kept AS (
  SELECT conv_id, e, edit, CASE WHEN edit <> 'I' THEN roles[place] END AS role,
    CASE WHEN edit = 'I' THEN '' ELSE texts[place] END AS text FROM lettered WHERE edit <> 'D'
), ranked AS (
  SELECT *, row_number() OVER w - (first_value(edit = 'K' AND role LIKE 's%') OVER w)::INT AS k FROM kept WINDOW w AS (PARTITION BY conv_id ORDER BY e)
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY e) AS lines
  FROM ranked GROUP BY conv_id
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM ids LEFT JOIN audited ON audited.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN repaired ON repaired.conv_id IS NOT DISTINCT FROM ids.conv_id"""
