import hashlib
import heapq
import random
import re
import zlib

from cellsight.llm import queries, repair
from tests.test_queries import SF

SCHEMA = "conv_id long, turn long, role string, text string, conv string, kind int, first string, tie int, rank int"
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        for _ in range(2 if hit == 3 else 1):
            yield conv, turn, "user" if hit == 4 else role, text


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        rest = text.strip(SPACE)
        out.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns, found):
    """The edits with the least cost, then the least letters, by uniform-cost search over what has been put out."""
    heap = [(0, "", 0, "", [])]
    done = set()
    while heap:
        cost, letters, i, shape, out = heapq.heappop(heap)
        place = shape[-1:]
        if (i, place) in done:
            continue
        done.add((i, place))
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", shape):
            return cost, letters, "\n".join(f"{r}:{t}" for r, t in out)

        def push(more, letter, j, role, text=""):
            now = shape if role is None else shape + role[:1]
            if role is None or (role and re.fullmatch("s?(ua)*u?", now)):
                heapq.heappush(heap, (cost + more, letters + letter, j, now, out if role is None else [*out, (role, text)]))

        for role in ("user", "assistant"):
            push(2, "I", i, role)
        if i < len(turns):
            _, role, text = turns[i]
            push(3, "D", i + 1, None)
            if found[i] not in ("blank", "duplicate"):
                more = found[i] == "truncated"
                push(more, "K", i + 1, role, text)
                for other in ("user", "assistant"):
                    push(2 + more, "R", i + 1, other, text)


def slow(rows):
    by = {r[0]: [] for r in rows}
    for conv, *turn in damage(rows):
        by[conv].append(tuple(turn))
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).hexdigest()))
        found = faults(turns)
        numbers = {t[0] for t in turns if t[0] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, text = cheapest(turns, found)
        yield conv, gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def check(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], SCHEMA).repartition(3)
    got, want = rows_of(repair.repair(df, **more)), sorted(slow(rows), key=str)
    assert got == want, [(g, w) for g, w in zip(got, want) if g != w][:3]


def some(rng, conv, n):
    roles = ["system", "user", "assistant", "user", "assistant", "User", "", None, "tool", " "]
    texts = ["Yes.", "No!", "well", "", " \t", None, "é…", "Why? ", "so.\n\x0b", "a.b", "long " * 50 + "."]
    return [(conv, rng.choice([None, t, t, t, t + 3]), rng.choice(roles[:5] if rng.random() < 0.7 else roles), rng.choice(texts)) for t in range(n)]


def test_equals_uniform_cost_search(spark):
    rng = random.Random(5)
    rows = [r for conv in [None, *range(150)] for r in some(rng, conv, rng.randint(1, 12))]
    check(spark, rows + rows[:40])  # repeated rows
    check(spark, rows[:300], block_turns=3)


def test_long_conversations_in_blocks(spark):
    rng = random.Random(6)
    check(spark, some(rng, 1, 400) + some(rng, 2, 9) + some(rng, None, 70), block_turns=7)


def test_empty_dropped_and_equal_turns(spark):
    check(spark, [])
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    check(spark, [(dropped, 1, "user", "Hi."), (dropped, 1, None, None)])
    check(spark, [(7, 5, "user", "Same.")] * 30 + [(8, None, None, None)] * 9)


def test_repaired_turns_have_the_shape():
    rng = random.Random(7)
    a = repair.Automaton()
    for _ in range(300):
        symbols = "".join(rng.choice("bdsuaoSUAO") for _ in range(rng.randint(0, 30)))
        states, total = a.scan(symbols, a.end)
        letters, place = a.trace(symbols, states, 0)
        assert repair.DONE[place] == 0 or a.tail(place)
        assert letters.replace("I", "").__len__() == len(symbols)
    assert len(a.vectors) < 200


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.QUERIES["op12_repair"](spark, SF)) == sorted(slow(rows), key=str)
