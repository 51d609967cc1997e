"""Conversation repair, periodic runs and exact dedup against plain versions, with NULLs, ties, repeated rows and clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqframe.llm import exact, fuse, periodic, queries, turns
from seqframe.llm.text import blocks

SF = "/root/testdata/sf0.001"

SPACE = "[^\x20\x09-\x0d]"


# ---- conversations -------------------------------------------------------------------------------------------------


def damaged(rows):
    """The contract's damage, row by row."""
    out = []
    for conv, turn, role, text in rows:
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        role = "user" if what == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(what, 1)
    return out


def order(row):
    return (row[1] is not None, row[1] or 0, row[2].encode(), row[3].encode())


def judged(rows):
    """Faults of a conversation's rows in order."""
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = re.findall(SPACE, text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def best_edits(rows, faults):
    """Least (cost, audit) with its lines, over all states, row by row; insertions are edits of their own."""
    step = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserted(states):
        for _ in range(3):
            for s, (c, a, lines) in list(states.items()):
                for to in step[s].replace("s", ""):
                    new = (c + 3, a + "I", (*lines, {"u": "user:", "a": "assistant:"}[to]))
                    states[to] = min(states.get(to, new), new)
        return states

    states = {"": (0, "", ())}
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        new = {}

        def offer(s, value):
            new[s] = min(new.get(s, value), value)

        for s, (c, a, lines) in inserted(states).items():
            offer(s, (c + 4, a + "D", lines))
            if fault not in ("blank", "duplicate"):
                cut = 3 * (fault == "truncated")
                if role[:1] and role[:1] in step[s]:
                    offer(role[:1], (c + cut, a + "K", (*lines, f"{role}:{text}")))
                for to in step[s].replace("s", ""):
                    offer(to, (c + 3 + cut, a + "R", (*lines, ("user:" if to == "u" else "assistant:") + text)))
        states = new
    states = inserted(states)
    return min(states[s] for s in ("", "a") if s in states)


def plain_repair(rows, original):
    found = {}
    for conv in {r[0] for r in original}:
        mine = sorted((r for r in rows if r[0] == conv), key=order)
        faults = judged(mine)
        n = collections.Counter(faults)
        turns_ = {r[1] for r in mine} - {None}
        gaps = max(turns_) - min(turns_) + 1 - len(turns_) if turns_ else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, lines = best_edits(mine, faults)
        found[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def made_up(seed, convs, most):
    rnd = random.Random(seed)
    rows = []
    for c in [None, *range(convs)]:
        for t in range(rnd.randint(0 if c is None else 1, most)):
            turn = rnd.choice([t, t, t, None, rnd.randint(-3, most)])
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ux"])
            text = rnd.choice(["Yes.", "no", "x" * rnd.randint(1, 9) + "?", f"t{t}. ", "", None, " \t\n", "aé. ", "ok! "])
            rows += [(c, turn, role, text)] * rnd.choice([1, 1, 1, 1, 3])
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"
CLASH = ("conv", "copies", "fault", "said", "first", "part", "seq", "letters", "_what", "_", "cost")


def result(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("small", [False, True])
def test_conversations(spark, monkeypatch, small):
    if small:  # chunks of two rows, spread over range partitions, and unrolled in steps of three
        monkeypatch.setattr(turns, "CHUNK_ROWS", 2)
        monkeypatch.setattr(turns, "_UNROLL", 3)
    rows = made_up(5, 60, 14) + [(1000, t, "user", "more.") for t in range(700)] + [(1001, None, "assistant", "same.")] * 500
    rows += [(1002, t, "user" if t % 2 == 0 else "assistant", f"turn {t}{'.' * (t % 5 > 0)}") for t in range(900)]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in CLASH}).repartition(5)
    got = result(turns.report(table, turns.repair(turns.damage(table))))
    want = plain_repair(damaged(rows), rows)
    assert got == want
    assert {x for g in got.values() for x in g[6]} == set("KRDI")


def test_conversation_of_one_key_is_spread(spark):
    """A conversation that holds all rows is packed by more than one task."""
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(5000)]
    table = spark.createDataFrame(rows, SCHEMA)
    marked = turns.faults(table).select("conv", "turn", "role", "text")
    ordered = marked.repartitionByRange(8, "conv", "turn", "role", F.substring("text", 1, 64))
    sizes = [r[0] for r in ordered.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) >= 6 and max(sizes) < 1500
    got = result(turns.report(table, turns.repair(table)))
    assert got == {7: plain_repair(rows, rows)[7]}


def test_conversations_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert turns.report(none, turns.repair(turns.damage(none))).count() == 0
    key = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(key, 0, "user", "Gone.")], SCHEMA)
    assert result(turns.report(one, turns.repair(turns.damage(one)))) == {key: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_powers_equal_single_steps():
    rnd = random.Random(3)
    for _ in range(300):
        symbol, n, v = rnd.choice(turns.SYMBOLS), rnd.randint(0, 300), (0, 6, 3, 0)
        for _ in range(rnd.randint(0, 4)):
            v = turns.before(rnd.choice(turns.SYMBOLS), 1, v)
        step = v
        for _ in range(n):
            step = turns.before(symbol, 1, step)
        assert turns.before(symbol, n, v) == step
        letters, _ = turns.unroll(symbol, n, v, turns.START)
        assert sum(x != "I" for x in letters) == n


# ---- periodic runs -------------------------------------------------------------------------------------------------


def plain_runs(words):
    n, runs = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(6, 4 * q) and not any(all(words[start + j] == words[start + j + p] for j in range(length - p)) for p in range(1, q)):
                runs.append((start, length, q))
            i += i == start
    return sorted(runs, key=lambda r: (r[0], r[2]))


def plain_document(doc_id, text):
    words = re.findall(SPACE + "+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in drop)))


def repetitive(rnd, n):
    words = [rnd.choice("abcdefgh"[: rnd.choice([1, 2, 3, 8])]) if rnd.random() < 0.5 else str(rnd.randint(0, 30)) for _ in range(n)]
    for _ in range(rnd.randint(0, 4)):
        if n > 8:
            a = rnd.randrange(n)
            p, end = rnd.randint(1, max(1, (n - a) // 4)), rnd.randint(a, n)
            for i in range(a, end):
                words[i] = words[a + (i - a) % p]
    return words


def test_runs_of_words():
    rnd = random.Random(8)
    for _ in range(150):
        docs = [repetitive(rnd, rnd.choice([0, 1, 5, 24, 80, 300])) for _ in range(rnd.randint(0, 6))]
        texts = [rnd.choice(["", " "]) + rnd.choice([" ", "\t\n"]).join(d) for d in docs]
        got = []
        for _, _, buf, offsets in blocks(pa.array(texts, pa.string()), 600):
            sizes, runs, collapsed = periodic._block(buf, offsets)
            got += list(zip(sizes.to_pylist(), runs.to_pylist(), collapsed.to_pylist(), strict=True))
        for words, (n, runs, text) in zip(docs, got, strict=True):
            want = plain_runs(words)
            drop = {i for s, length, q in want for i in range(s + q, s + length)}
            assert n == len(words) and [tuple(r.values()) for r in runs] == want
            assert text == " ".join(w for i, w in enumerate(words) if i not in drop)


def test_runs_nested_at_many_scales():
    """A period that is itself made of runs, repeated: all levels are found, and Fibonacci and Thue-Morse words have none of exponent 4."""
    word = ["a"]
    for k in range(5):
        word = word * 5 + [f"end{k}"]
    w = np.unique(word, return_inverse=True)[1]
    got = periodic.find_runs(np.r_[w, 10**6], np.array([len(w)]))
    assert list(zip(*(x.tolist() for x in got), strict=True)) == plain_runs(word)
    fib, old = [0, 1], [0]
    while len(fib) < 5000:
        fib, old = fib + old, fib
    morse = [bin(i).count("1") & 1 for i in range(5000)]
    for words in (fib, morse):
        assert not len(periodic.find_runs(np.r_[words, 10**6], np.array([len(words)]))[0])


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(2)
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(None, "x " * 50), (90000, None), (90001, ""), (90002, " \n\t "), (90003, "one"), (90003, "one"), (90004, "la " * 4000), (90005, "ünï \x00   " * 9)]
    rows += [(10**6 + i, " ".join(repetitive(rnd, rnd.randint(1, 250)))) for i in range(150)]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    return table.unionByName(extra).withColumns({c: F.lit(1) for c in ("runs", "collapsed", "n_words", "digest", "class", "row", "id", "sha", "head", "batch", "top")})


def test_periodic_query(spark, texts):
    found = periodic.collapse_runs(texts, text=periodic.repeat_words(F.col("text"), F.col("doc_id")))
    got = sorted((tuple(r) for r in periodic.summary(found).collect()), key=str)
    rows = [(r.doc_id, r.text) for r in texts.collect()]
    assert got == sorted((plain_document(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 60
    assert periodic.collapse_runs(texts.limit(0)).count() == 0


def test_periodic_registered(spark):
    got = queries.QUERIES["op12_periodic_runs"](spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, got.collect())) == sorted(plain_document(*r) for r in rows)


# ---- exact dedup ---------------------------------------------------------------------------------------------------


def test_fuse_filters():
    for n in (0, 1, 2, 3, 7, 50, 4096, 30000):
        keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
        built = fuse.build(np.r_[keys, keys])
        assert fuse.passes(keys, *built).all()
        other = np.random.default_rng(99).integers(0, 2**63, 200_000).astype(np.uint64)
        assert fuse.passes(other, *built).mean() < 1.3 / 256
        assert len(built[3]) <= 40 + 1.5 * n + 8


@pytest.mark.parametrize(("digest_bytes", "batches"), [(32, 2), (1, 1), (1, 3)])  # one byte: nearly every digest belongs to several texts
def test_exact_dedup(spark, texts, monkeypatch, digest_bytes, batches):
    monkeypatch.setattr(exact, "KEYS", 16)
    numbered = texts.withColumn("_b", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)))
    done = exact.deduplicate([numbered.where(F.col("_b") == b) for b in range(batches)], digest_bytes=digest_bytes)
    got = sorted((tuple(r) for r in done.select("id", "keep_id", "group_size", F.hex("sha")).collect()), key=str)
    rows = [(r.doc_id, r.text or "") for r in texts.collect()]
    size = collections.Counter(t for _, t in rows)
    keep = {}
    for i, t in rows:
        keep[t] = i if keep.get(t) is None else max(keep[t], i if i is not None else keep[t])
    assert got == sorted(((i, keep[t], size[t], hashlib.sha256(t.encode()).hexdigest().upper()) for i, t in rows), key=str)
    kept = done.where("kept")
    assert kept.count() == len(size) == kept.select("sha").distinct().count()
    assert not kept.where("not (id <=> keep_id)").count()


def test_exact_dedup_across_snapshots(spark, monkeypatch):
    monkeypatch.setattr(exact, "KEYS", 8)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first, a = exact.ingest(frame([(i, f"text {i}") for i in range(200)]))
    assert a.filters.count() == a.buckets == 25 and first.count() == 200
    second, b = exact.ingest(frame([(1000 + i, f"text {i}") for i in range(150, 260)]), [a])
    assert b.texts.count() == 60  # only what the first snapshot lacks
    assert first.join(second, "class").count() == 50
    asked = second.select(F.col("class").alias("digest"))
    passed = exact.screen(asked, a).count()
    assert 50 <= passed < 60  # no miss, few others
    none, empty = exact.ingest(frame([]), [a, b])
    assert none.count() == 0 and empty.texts.count() == 0
    assert exact.deduplicate([frame([])]).count() == 0
