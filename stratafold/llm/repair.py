"""Conversation structure repair: cheapest edits by an auction shortest-path algorithm.

A conversation is to read ``s?(ua)+`` by the first letters of its roles, or to be empty. Each row is kept (0), given the role
user or assistant (3) or deleted (4); an empty user or assistant turn may be inserted anywhere (3); a truncated row that stays
costs 3 more; blank rows and duplicates have to go. The edits are the arcs of a lattice whose nodes are (rows read, role last
written), and the cheapest audit is a shortest path.

* **Auction.** Every node has a price, never more than the cost of an arc plus the price of its head. A path from an origin is
  extended along an arc that meets its price exactly; where none does, the price of the end node rises to the least such sum
  and the path is contracted. A path ends at a node whose price has converged. Origins are taken from the last row backwards
  and start at the least price of the row behind them, so each path is short and the work is linear in the rows.
* **Tight arcs.** Converged prices are the distances to the end, so the arcs that meet them exactly are those of all cheapest
  edits. Labels leave a node only once, therefore the smallest tight label at each node gives the smallest audit.

Row numbers, duplicates and faults are found by aggregates and joins that split a conversation of any size; one letter a row
goes to the auction, as long as the audit that it returns. The repaired turns pass in order through one task with constant memory.

Defined cases: a null role or text is one space, a null identifier is one conversation and a null turn comes first; rows of one
turn are ordered by their role and a hash of their text, copies adjacent; equal rows are duplicates; a role that begins with none
of s, u, a cannot be kept; a conversation without rows has an empty audit; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import null_safe_join, row_numbers
from .frames import partitions, pick, stored

RUN = 4096  # rows whose letters are joined at once
NONBLANK = "[^\\x20\\x09-\\x0D]"
# Costs of the edits, in the order of their letters.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
# Grammar states: nothing written, then last written s, u, a.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
LEGAL = {"su", "ua", "au"}


def _arcs() -> dict[tuple[str, int], list[tuple[str, int, int, int]]]:
    """(label, rows read, next state, cost) by letter of the row ("" after the last row) and state, in order of labels.

    Letters: A to P number the pairs (first letter of the role: s, u, a, other; fault: none, blank, duplicate, truncated)."""
    out = {}
    for q in range(4):
        insert = ("I", 0, _NEXT[q], INSERT)
        out["", q] = [insert]
        for k in range(16):
            first, fault = divmod(k, 4)
            more = TRUNCATED if fault == 3 else 0
            arcs = [("D", 1, q, DELETE), insert]
            if fault in (0, 3):
                own = {0: SYSTEM, 1: USER, 2: ASSISTANT}.get(first)
                if own == SYSTEM and q == NOTHING or own is not None and own != SYSTEM and own == _NEXT[q]:
                    arcs.append(("K", 1, own, more))
                arcs.append(("R", 1, _NEXT[q], REROLE + more))
            out[chr(65 + k), q] = arcs
    return out


_ARCS = _arcs()


def auction(letters: str) -> list[int]:
    """Converged prices of the nodes 4 * (rows read) + state."""
    n = len(letters)
    price = [0] * (4 * n + 4)
    done = bytearray(4 * n + 4)
    done[4 * n + NOTHING] = done[4 * n + ASSISTANT] = 1  # an accepted end costs nothing more
    for i in range(n, -1, -1):
        letter = letters[i] if i < n else ""
        if i < n:  # no arc costs less than nothing, so the least price of the next row is a feasible start: prices need not climb from 0
            price[4 * i : 4 * i + 4] = [min(price[4 * i + 4 : 4 * i + 8])] * 4
        for origin in range(4 * i, 4 * i + 4):
            if done[origin]:
                continue
            path = [origin]
            while True:
                v = path[-1]
                least, head = min((cost + price[4 * (i + rows) + to], 4 * (i + rows) + to) for _, rows, to, cost in _ARCS[letter, v & 3])
                if price[v] < least:
                    price[v] = least
                    if len(path) > 1:
                        path.pop()
                elif done[head]:
                    for x in path:
                        done[x] = 1
                    break
                else:
                    path.append(head)
    return price


@lru_cache(maxsize=50_000)
def _short_repair(letters: str) -> tuple[int, str]:
    return _repair(letters)


def _repair(letters: str) -> tuple[int, str]:
    price = auction(letters)
    i, q, audit = 0, NOTHING, []
    n = len(letters)
    while i < n or q not in (NOTHING, ASSISTANT):
        here = price[4 * i + q]
        for label, rows, to, cost in _ARCS[letters[i] if i < n else "", q]:
            if here == cost + price[4 * (i + rows) + to]:
                audit.append(label)
                i, q = i + rows, to
                break
    return price[NOTHING], "".join(audit)


def cheapest_repair(letters: str) -> tuple[int, str]:
    """(cost, audit) of a conversation of one letter a row; short ones are remembered."""
    return _short_repair(letters) if len(letters) <= 16 else _repair(letters)


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, role0, text0, copy): rows dropped, emptied, cut, repeated or given another role by a check sum."""
    t = pick(turns, "conv_id", "turn", "role", "text")
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = t.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role0"), space("text").alias("text0"),
                 F.pmod(F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "utf-8")), F.lit(20)).alias("f"))
    text = F.when(F.col("f") == 1, "").when(F.col("f") == 2, F.translate("text0", ".!?", "")).otherwise(F.col("text0"))
    role = F.when(F.col("f") == 4, "user").otherwise(F.col("role0"))
    copies = F.explode(F.when(F.col("f") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return t.where("f <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), "role0", "text0", copies.alias("copy"))


def ordered(turns: DataFrame) -> DataFrame:
    """Adds ``pos`` from 1 in the order of turns; ``role0``, ``text0`` and ``copy`` order the rows of one turn."""
    t = turns.withColumn("tie", F.xxhash64("text0"))
    return row_numbers(t, ["conv_id"], ["turn", "role0", "tie", "copy"], "pos").select("conv_id", "turn", "role", "text", "pos")


def _fault(text: Column, repeated: Column) -> Column:
    """0 none, 1 blank, 2 duplicate, 3 truncated."""
    last = F.regexp_extract(text, "([.!?])[\\x20\\x09-\\x0D]*\\z", 1) == ""
    return F.when(~F.rlike(text, F.lit(NONBLANK)), 1).when(repeated, 2).when(last, 3).otherwise(0)


def row_letters(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, letter) of ordered rows."""
    t = rows.select("conv_id", "pos", "role", "text", F.sha2(F.encode("text", "utf-8"), 256).alias("d"))
    again = t.groupBy("conv_id", "role", "d").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    t = null_safe_join(t, again, ["conv_id", "role", "d"], "left")
    fault = _fault(F.col("text"), F.coalesce(F.col("pos") > F.col("first"), F.lit(False)))
    first = F.substring("role", 1, 1)
    kind = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return t.select("conv_id", "pos", F.chr(F.lit(65) + kind * 4 + fault).alias("letter"))


def conversation_letters(letters: DataFrame) -> DataFrame:
    """(conv_id, letters): the letters of a conversation in order, joined by runs first."""
    run = letters.groupBy("conv_id", F.floor(F.col("pos") / RUN).alias("r")).agg(F.array_sort(F.collect_list(F.struct("pos", "letter"))).alias("x"))
    run = run.select("conv_id", "r", F.concat_ws("", F.transform("x", lambda s: s["letter"])).alias("x"))
    whole = run.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("r", "x"))).alias("x"))
    return whole.select("conv_id", F.concat_ws("", F.transform("x", lambda s: s["x"])).alias("letters"))


def audits(letters: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit) from (conv_id, letters)."""

    def run(batches):
        for b in batches:
            out = []
            for seq in b.column(1).to_pylist():
                fault = [(ord(c) - 65) % 4 for c in seq]
                first = "".join("sua?"[(ord(c) - 65) // 4] for c in seq)
                out.append((fault.count(1), fault.count(2), fault.count(3), sum(a + c not in LEGAL for a, c in zip(first, first[1:])), *cheapest_repair(seq)))
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                                             ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    kind = dict(letters.dtypes)["conv_id"]
    return letters.mapInArrow(run, f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the turns after the audits, in order inside each partition; no conversation is split."""
    kind = dict(rows.dtypes)["conv_id"]
    both = rows.select("conv_id", "pos", "role", "text").unionByName(found.select("conv_id", F.lit(0).cast(dict(rows.dtypes)["pos"]).alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text")))
    dealt = both.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "pos")
    names = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}

    def run(batches):
        conv, audit, at, state, position = None, "", 0, NOTHING, 0
        out: list[tuple] = []

        def write(edit: str, text: str, role: str = ""):
            nonlocal state, position
            state = SYSTEM if edit == "K" and role[:1] == "s" else _NEXT[state]
            position += 1
            out.append((conv, position, edit, role if edit == "K" else names[state], text))

        def inserted():
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                at += 1
                write("I", "")

        def batch():
            cols = list(zip(*out)) or [()] * 5
            out.clear()
            types = (conv_type, pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], ["conv_id", "position", "edit", "role", "text"])

        conv_type = pa.string()
        for b in batches:
            conv_type = b.schema.field(0).type
            for k in range(0, b.num_rows, 512):
                for c, pos, role, text in zip(*(x.to_pylist() for x in b.slice(k, 512).columns)):
                    if pos == 0:
                        inserted()
                        conv, audit, at, state, position = c, text, 0, NOTHING, 0
                        continue
                    inserted()
                    edit = audit[at]
                    at += 1
                    if edit != "D":
                        write(edit, text, role)
                yield batch()
            inserted()  # what ends the last conversation so far holds whether or not more of its rows come
            yield batch()

    return dealt.mapInArrow(run, f"conv_id {kind}, position long, edit string, role string, text string")


def transcript_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the newline-joined ``role:text`` of ordered turns whose conversations are not split over partitions."""
    kind = dict(turns.dtypes)["conv_id"]

    def run(batches):
        conv, digest, conv_type = None, None, None
        for b in batches:
            conv_type = b.schema.field(0).type
            ids, out = [], []
            for k in range(0, b.num_rows, 512):
                for c, position, role, text in zip(*(x.to_pylist() for x in b.slice(k, 512).columns)):
                    if position == 1:
                        if digest is not None:
                            ids.append(conv)
                            out.append(digest.hexdigest())
                        conv, digest = c, hashlib.sha256()
                    else:
                        digest.update(b"\n")
                    digest.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, conv_type), pa.array(out, pa.string())], ["conv_id", "sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], conv_type), pa.array([digest.hexdigest()], pa.string())], ["conv_id", "sha256"])

    return turns.select("conv_id", "position", "role", "text").mapInArrow(run, f"conv_id {kind}, sha256 string")


def turn_gaps(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps): turn numbers missing between the first and the last."""
    t = rows.where("turn is not null").select("conv_id", "turn").distinct()
    return t.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))


def repair_report(turns: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conversation of ``turns``: faults, cheapest audit and digest of the repaired (already ordered) ``rows``."""
    found = stored(audits(conversation_letters(row_letters(rows))), "audits")
    digest = transcript_digests(repaired_turns(rows, found))
    out = null_safe_join(pick(turns, "conv_id").distinct(), turn_gaps(rows), ["conv_id"], "left")
    out = null_safe_join(null_safe_join(out, found, ["conv_id"], "left"), digest, ["conv_id"], "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def repair_damaged(turns: DataFrame) -> DataFrame:
    """The report over conversations after the damage by check sums."""
    return repair_report(turns, stored(ordered(damage(turns)), "turns"))


ORACLE = r"""
with recursive tab as (
    select list(c order by n) as tab from (select n, list_reduce(list_prepend(n, range(0, 8)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as c
    from (select unnest(range(0, 256)) as n))),
src as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
crc as (select *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: ascii(x)::bigint)),
    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 20 as f from src, tab),
dmg as (select conv_id, turn, case when f = 4 then 'user' else role end as role,
    case when f = 1 then '' when f = 2 then translate(text, '.!?', '') else text end as text, role as role0, text as text0, unnest(case when f = 3 then [0, 1] else [0] end) as copy
    from crc where f <> 0),
ord as (select *, row_number() over (partition by conv_id order by turn nulls first, role0, text0, copy) as pos from dmg),
flt as (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 1
    when row_number() over (partition by conv_id, role, text order by pos) > 1 then 2
    when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 3 else 0 end as fault,
    case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else '?' end as ini from ord),
legal as (select *, lag(ini) over (partition by conv_id order by pos) || ini as pair from flt),
nums as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate,
    count(*) filter (fault = 3) as truncated, count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) as illegal from legal group by conv_id),
nxt as (select * from (values (0, 2), (1, 2), (2, 3), (3, 2)) t(q, q2)),
arcs as (
    select ini, fault, q, q as q2, 'D' as label, 4 as cost from (values ('s'), ('u'), ('a'), ('?')) a(ini), range(0, 4) b(fault), range(0, 4) c(q)
    union all select ini, fault, q, q2, 'R', case when fault = 3 then 6 else 3 end from (values ('s'), ('u'), ('a'), ('?')) a(ini), (values (0), (3)) b(fault), nxt
    union all select ini, fault, q, q2, 'K', case when fault = 3 then 3 else 0 end from (values (0), (3)) b(fault),
        (values ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)) k(ini, q, q2)),
ins as (select * from (values (0, 0, '', 0), (1, 1, '', 0), (2, 2, '', 0), (3, 3, '', 0), (0, 2, 'I', 3), (1, 2, 'I', 3), (2, 3, 'I', 3), (3, 2, 'I', 3), (0, 3, 'II', 6), (1, 3, 'II', 6)) t(q, q2, label, cost)),
dp as (
    select conv_id, 0::bigint as pos, q2 as q, cost as c, label as a from (select distinct conv_id from flt), ins where q = 0
    union all
    select conv_id, pos, q, c, a from (select *, row_number() over (partition by conv_id, q order by c, a) as rn from (
        select d.conv_id, r.pos, y.q2 as q, d.c + x.cost + y.cost as c, d.a || x.label || y.label as a
        from dp d join flt r on r.conv_id is not distinct from d.conv_id and r.pos = d.pos + 1
        join arcs x on x.ini = r.ini and x.fault = r.fault and x.q = d.q join ins y on y.q = x.q2) z) where rn = 1),
best as (select conv_id, arg_min(c, (c, a)) as cost, arg_min(a, (c, a)) as audit
    from dp where q in (0, 3) and pos = (select max(pos) from flt f where f.conv_id is not distinct from dp.conv_id) group by conv_id),
lab as (select conv_id, i, audit[i] as e, len(replace(audit[1 : i], 'I', '')) as pos, len(replace(audit[1 : i], 'D', '')) as k from best, range(1, len(audit) + 1) t(i)),
kept as (select l.*, r.role, r.text, max(case when l.e = 'K' and r.ini = 's' then 1 else 0 end) over (partition by l.conv_id) as sys
    from lab l left join flt r on r.conv_id is not distinct from l.conv_id and r.pos = l.pos and l.e <> 'I' where e <> 'D'),
txt as (select conv_id, string_agg(case when e = 'K' then role when (k - sys) % 2 = 1 then 'user' else 'assistant' end || ':' || case when e = 'I' then '' else text end, chr(10) order by i) as t
    from kept group by conv_id)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
    coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(t, '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join nums n on n.conv_id is not distinct from o.conv_id
left join best b on b.conv_id is not distinct from o.conv_id left join txt x on x.conv_id is not distinct from o.conv_id
"""
