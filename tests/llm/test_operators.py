"""Each operator against its plain version, with NULLs, empty and repeated rows, and columns of clashing names."""

import collections
import gzip
import hashlib
import io
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqframe.functions.scratch import materialize
from seqframe.llm import decontaminate, katz, language, licenses, lines, mixing, near, repeats, suffix, text, vectors, warc
from seqframe.llm.suffix import common_prefixes, shared_suffixes, suffix_array
from seqframe.llm.text import grams, running, span_hash
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """The small documents, edge cases, and columns named like those the operators use inside."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    long = "and the of " * 3000
    odd = [(None, "the and of it"), (90000, None), (90001, ""), (90002, "!!! ..."), (90003, "qqq zzz1 the and"), (90003, "qqq zzz1 the and"), (90004, long), (90005, "\n\n\n"), (90006, "Ünï çødé\x00 ünï")]
    extra = spark.createDataFrame([(i, t, None, None, 0) for i, t in odd], table.schema)
    table = table.unionByName(extra)
    clash = {c: F.lit(1) for c in ("doc", "h", "row", "w", "kept", "copy", "batch", "train", "n", "mix_slot", "_id", "score")}
    return materialize(table.withColumns(clash))


def pairs(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_katz(spark, docs, monkeypatch):
    train = ~language.fold(F.col("doc_id"), 7, 2)
    rows = [(r.doc_id, r.text, r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in docs.collect()]
    want = sorted(brute.katz(rows, katz.discounts), key=str)
    for small in (False, True):
        if small:  # several batches and flushes, few held pairs
            for name, value in (("BATCH", 50_000), ("HOT", 200), ("FREQUENT", 500)):
                monkeypatch.setattr(katz, name, value)
        got = pairs(katz.score_texts(docs, train), "doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        assert [g[:4] for g in got] == [w[:4] for w in want]
        assert np.allclose([g[4:] for g in got], [w[4:] for w in want], atol=1e-6)
    assert {r.score for r in katz.score_texts(docs, F.lit(False)).collect()} == {0.0}
    assert katz.score_texts(docs.limit(0), train).count() == 0


def test_lines(spark, docs):
    byte_hash = lambda b: int(span_hash(running(np.frombuffer(b, np.uint8)), np.array([0]), np.array([len(b)]))[0])
    roll = lambda h: int(span_hash(running(np.array(h, np.uint64)), np.array([0]), np.array([len(h)]))[0])
    seen, want = {}, {}
    for i, t in sorted({(r.doc_id if r.doc_id is not None else 1 << 62, r.text or "") for r in docs.collect()}):
        parts = t.encode().split(b"\n")
        hashes = [byte_hash(p) for p in parts]
        kept, gone, chunk = [], 0, []
        for k in range(len(parts)):
            chunk.append(k)
            if k + 1 < len(parts) and (roll(hashes[max(0, k - lines.ROLL + 1) : k + 1]) >> 11) % lines.EVERY:
                continue
            text = b"\n".join(parts[c] for c in chunk)
            if t and len(chunk) >= lines.LEAST and text in seen:
                gone += len(chunk)
            else:
                if len(chunk) >= lines.LEAST:
                    seen[text] = i
                kept += [parts[c] for c in chunk]
            chunk = []
        want[i, t] = len(parts), gone, b"\n".join(kept).decode()
    done = lines.dedup_lines(docs, carry=tuple(docs.columns))
    for r in done.collect():
        expect = want[r.doc_id if r.doc_id is not None else 1 << 62, r["row"].text or ""]
        assert (r.n_lines, r.n_removed, r.kept or "") == expect
        assert (r.kept is None) == (r["row"].text is None)
    assert done.count() == docs.count() and done.where("n_removed > 0").count() > 0
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_lines_remove_whole_planted_runs(spark, docs):
    """Passages of 2 to 6 lines between foreign lines go whole; any text against a plain version."""
    rng = random.Random(8)
    planted = [(k, [f"passage {k} {i} {rng.random()}" for i in range(k)]) for k in range(2, 7) for _ in range(8)]
    rows, shared = [], {}
    for at, (k, lines_of) in enumerate(planted):
        for copy in range(2):
            near_by = [[f"own {at} {copy} {side} {rng.random()}" for _ in range(rng.randint(0, 3))] for side in range(2)]
            rows.append((200_000 + 2 * at + copy, "\n".join([*near_by[0], *lines_of, *near_by[1]])))
            shared[rows[-1][0]] = k * copy
    rows += [(300_000, "a\na\na\na"), (300_001, "\n\n"), (300_002, "b\na\na\nc\nb\na"), (300_003, "c\nb"), (300_004, "c"), (300_005, "c\nb\n")]
    table = docs.select("doc_id", "text", "h").unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    seen, want = set(), {}
    for i, t in sorted({(r.doc_id if r.doc_id is not None else 1 << 62, r.text or "") for r in table.collect()}):
        parts = t.split("\n")
        gone = set()
        for k in range(len(parts) - 1):
            two = parts[k], parts[k + 1]
            gone |= {k, k + 1} if two in seen else set()
            seen.add(two)
        want[i, zlib.crc32(t.encode())] = len(gone), hashlib.sha256("\n".join(x for k, x in enumerate(parts) if k not in gone).encode()).hexdigest()
    found = lines.dedup_lines(table, carry=("text",), runs=True).collect()
    for r in found:
        key = r.doc_id if r.doc_id is not None else 1 << 62, zlib.crc32((r["row"].text or "").encode())
        assert (r.n_removed, hashlib.sha256((r.kept or "").encode()).hexdigest()) == want[key]
    assert len(found) == table.count()
    assert {r.doc_id: r.n_removed for r in found if r.doc_id in shared} == shared


def test_contamination(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    extra = [(900, "The and"), (901, ""), (902, None), (903, "Of was oran. Ha edble a"), (None, "qqq zzz1")]
    items = items.unionByName(spark.createDataFrame(extra, items.schema))
    want = sorted(brute.contamination([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]), key=str)
    for limit in (decontaminate.MAX_HELD, 0):
        found = decontaminate.contamination(docs, items, held_limit=limit)
        assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found.collect()), key=str) == want
    assert {r.n_hit for r in decontaminate.contamination(docs, items.limit(0)).collect()} == {0}
    assert decontaminate.contamination(docs.limit(0), items).count() == 0


def near_groups(rows, sketch, n):
    """Components of all links at the threshold, ids of texts with words only."""
    texts = {i: brute.alnum(t) for i, t in rows if i is not None and brute.alnum(t)}
    sets = {i: collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, w in texts.items()}
    word = lambda x: span_hash(running(np.frombuffer(x, np.uint8)), np.array([0]), np.array([len(x)]))[0]
    code = lambda s: grams(np.array([word(x) for x in s], np.uint64), np.array([0, len(s)]), 5)[1][0] >> np.uint64(12)
    codes = {s: code(s) for c in sets.values() for s in c}
    weight = dict(zip(codes, near.idf(np.array(list(codes.values()), np.uint64), sketch, n)))
    holders = collections.defaultdict(list)
    for i, c in sets.items():
        for s in c:
            holders[s].append(i)
    groups = brute.Groups(sets)
    total = {i: sum(k * weight[s] for s, k in c.items()) for i, c in sets.items()}
    for a, b in {(x, y) for h in holders.values() for x in h for y in h if x < y}:
        shared = sum(min(k, sets[b][s]) * weight[s] for s, k in sets[a].items() if s in sets[b])
        if shared / (total[a] + total[b] - shared) >= near.THRESHOLD:
            groups.join(a, b)
    return {i: groups.find(i) for i in sets}


def test_near_duplicates(spark, docs, monkeypatch):
    random.seed(5)
    base = [f"w{random.randrange(500)}" for _ in range(120)]
    copies = []
    for i in range(60):
        w = list(base)
        w[random.randrange(120)] = f"x{i}"
        copies.append((100_000 + i, " ".join(w)))
    table = docs.select("doc_id", "text", "copy", "n").unionByName(spark.createDataFrame(copies, "doc_id long, text string"), allowMissingColumns=True)
    sketch, n = near.frequency_sketch(table, "text")
    want = near_groups([(r.doc_id, r.text) for r in table.collect()], sketch, n)
    for chunk in (near.CHUNK, 8):
        monkeypatch.setattr(near, "CHUNK", chunk)
        found = near.near_duplicates(table).collect()
        assert all(r.component == want.get(r.doc_id, r.doc_id) and r.kept == (r.doc_id is None or r.component == r.doc_id) for r in found)
        assert len(found) == table.count()
    assert len({r.component for r in found if r.doc_id and r.doc_id >= 100_000}) == 1
    assert near.near_duplicates(table.limit(0)).count() == 0


def test_near_links_survive_false_attachments_and_chunks(spark, monkeypatch):
    """Spread near copies, each a change or more away from an earlier one: groups are those of all links, whatever leaders and chunks take up first."""
    rng = random.Random(11)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(150)] for _ in range(2)]
    while len(texts) < 300:
        w = list(rng.choice(texts[-40:]))
        for _ in range(rng.choice([2, 3, 3, 4])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**9)}"
        texts.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    rng.shuffle(rows)
    table = materialize(spark.createDataFrame(rows, "doc_id long, text string"))
    sketch, n = near.frequency_sketch(table, "text")
    want = near_groups(rows, sketch, n)
    assert 2 < len(set(want.values())) < 290
    for chunk in (near.CHUNK, 16):
        monkeypatch.setattr(near, "CHUNK", chunk)
        assert {r.doc_id: r.component for r in near.near_duplicates(table).collect()} == want


def test_near_pairs_of_a_group_grow_with_its_size():
    """A slot of like texts gives a few pairs a text, not all pairs."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 8, 192)
    sig = np.where(rng.random((800, 192)) < 0.92, base, rng.integers(0, 1 << 8, (800, 192))).astype(np.uint8)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7] * 800), pa.array([f"{i:04}".encode() for i in range(800)]), pa.array([s.tobytes() for s in sig]), pa.array([False] * 800), pa.array([7] * 800)],
        ["slot", "copy", "tiny", "big", "bucket"],
    )
    found = sum(b.num_rows for b in near._bucket_pairs(iter([batch])))
    assert 799 <= found <= 12 * 800


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(6, 12))
    rows = [(i, (centers[i % 6] + rng.normal(size=12) * rng.choice([0.05, 0.3])).tolist(), i % 3 if i % 11 else None) for i in range(400)]
    x = rows[1][1]
    rows += [(1000, None, 1), (1001, [0.0] * 12, 1), (1002, [float("nan")] * 12, 1), (1003, [None] * 12, 1), (1004, [], 1), (1005, [1.0], 1), (1006, [2e300], 1), (None, x, 1), (1007, x, 1), (1007, x, 1), (1008, [float("inf")] * 12, 1)]
    table = spark.createDataFrame([(*r, 5, 5) for r in rows], "vec_id long, embedding array<double>, label int, rep int, links int")
    want = sorted(brute.vectors(rows), key=str)
    for tile in (vectors.TILE, 16):
        assert pairs(vectors.near_vectors(table, tile=tile), "vec_id", "n_links", "component_id") == want
    assert sum(w[1] for w in want) > 1000
    assert vectors.near_vectors(table.limit(0)).count() == 0


def test_warc_round_trip(spark):
    big = "x" * 2_500_000
    rows = [(1, None, None), (2, "http://a b", big), (3, "u", big), (4, "u", "WARC/1.1\r\n\r\n" * 200), (None, "u", big), (3, "u", big), (5, "", "é\r\n\r\n"), (6, "u", "short"), (7, "u", "short")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string")
    files = warc.archive(pages)
    chunks = materialize(warc.read_chunks(spark, files, True, 1 << 18))
    groups = collections.defaultdict(list)
    for i, _, t in rows:
        if i is not None and len((t or "").encode()) >= 1000:
            groups[t].append(i)
    want = []
    for i, _, t in rows:
        b = (t or "").encode()
        again = i is not None and t in groups and max(groups[t]) != i
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", max(groups[t]) if again else None))
    assert pairs(warc.record_table(chunks), "id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=str)
    whole = collections.defaultdict(bytes)
    for r in sorted(chunks.where("warc_type = 'response'").collect(), key=lambda r: (r.file, r.record_no, r.chunk_no)):
        whole[r.file, r.record_no] += bytes(r.data)
        assert len(r.data) <= 1 << 18 and r.digest_so_far == hashlib.sha1(whole[r.file, r.record_no]).hexdigest()
    assert sorted(whole.values()) == sorted((t or "").encode() for (_, _, t), w in zip(rows, want) if w[3] == "response")
    assert warc.record_table(warc.read_chunks(spark, warc.archive(pages.limit(0)))).count() == 0


def test_warc_reader_takes_plain_files_and_rejects_cut_ones():
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    read = lambda raw: list(warc._records(io.BufferedReader(warc._Inflated(io.BytesIO(raw), 7)), 3, True))
    for raw in (record * 2, gzip.compress(record) * 2, gzip.compress(record * 2)):
        found = read(raw)
        assert [(r["record_no"], r["chunk_no"], r["data"], r["last"]) for r in found] == [(n, c, d, c == 1) for n in (0, 1) for c, d in ((0, b"hel"), (1, b"lo"))]
    for raw in (record[:-7], gzip.compress(record)[:-12]):
        with pytest.raises(ValueError):
            read(raw)


def test_licenses(spark, docs):
    words = lambda t: [w for w in re.split(r"[^a-z0-9\u0080-\U0010FFFF]+", (t or "").lower()) if w]
    cut = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    random.seed(3)
    rows = []
    for text in licenses.TEMPLATES.values():
        for k in range(7):
            w = text.split()
            for _ in range(k):
                w[random.randrange(len(w))] = "zzz"
            rows.append((70_000 + len(rows), "Foo bar. " * k + " ".join(w) + " qux " * len(rows)))
    table = docs.select("doc_id", "text", "h", "w").unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    want = set()
    for r in table.collect():
        own = cut(words(r.text))
        for name, text in licenses.TEMPLATES.items():
            whole = cut(words(text))
            if len(whole & own) / len(whole) >= licenses.CONTAINED:
                want.add((r.doc_id, name, len(whole), len(whole & own)))
    found = pairs(licenses.scan_licenses(table, licenses.default_templates(spark)), "doc_id", "license", "n_shingles", "n_found")
    assert found == sorted(want, key=str) and len(want) > 30
    none = spark.createDataFrame([("x", None), (None, "a b"), ("y", "!!")], "license string, text string")
    assert licenses.scan_licenses(table, none).count() == 0
    assert licenses.scan_licenses(table.limit(0), licenses.default_templates(spark)).count() == 0


def test_suffix_array():
    random.seed(2)
    for it in range(150):
        n, k = random.choice([1, 2, 3, 5, 20, 60, 200]), random.choice([1, 2, 3, 26])
        t = [random.randint(1, k) for _ in range(n)]
        if it % 4 == 0:
            t = (t[: max(1, n // 4)] * 5)[:n]
        t = np.array([*t, 0])
        sa = suffix_array(t)
        plain = t.tolist()
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: plain[i:])
        shared = common_prefixes(t.astype(np.uint8), sa, 100)
        for a, b in zip(sa[:-1].tolist(), sa[1:].tolist()):
            c = 0
            while c < 100 and max(a, b) + c < len(t) and t[a + c] == t[b + c]:
                c += 1
            assert shared[b] == c


def test_repeats(spark, docs):
    random.seed(1)
    parts = ["".join(random.choice("abcd ") for _ in range(random.randint(50, 400))) for _ in range(12)]
    rows = [(i, "".join(random.choice(parts) + random.choice(["", "x", "yy"]) for _ in range(random.randint(0, 6)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, " " * 5000), (1003, " " * 300), (1003, " " * 300), (None, "ab" * 200), (1004, "é" * 120), (1005, "ab" * 300)]
    table = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, h int, start int")
    want = sorted(brute.repeats(rows), key=str)
    for sizes in ({}, {"shard": 2, "array_bytes": 2000}):
        found = repeats.remove_repeats(table, **sizes)
        assert pairs(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found.collect())
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    assert pairs(repeats.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.repeats(plain), key=str)
    assert repeats.remove_repeats(table.limit(0)).count() == 0


def test_language(spark, docs):
    held = language.fold(F.col("doc_id"), 4, 2)
    profiles = language.fit(docs.where(~held))
    found = language.predict(docs.withColumn("held_out", held), profiles, ("doc_id", "held_out", "lang")).collect()
    truth = [r for r in found if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in truth) >= 0.98 * len(truth) > 0
    by = {r.doc_id: r for r in found}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (90000, 90001, 90002, 90005))
    assert all(0 <= r.score <= 1 for r in found) and len(found) == docs.count()
    assert {r.lang_pred for r in language.predict(docs, profiles.limit(0)).collect()} == {"und"}
    assert language.predict(docs.limit(0), profiles).count() == 0


def test_language_by_brute_force(spark, docs):
    """Distances, scores and ties against a plain version, over all rows and profiles of all labelled ones."""
    extra = spark.createDataFrame([(200_000 + i, t) for i, t in enumerate(["a", "zz9", "the", "der die das", "é", "x" * 2000, "a\0b"])], "doc_id long, text string")
    table = docs.select("doc_id", "text", "lang", "score").unionByName(extra, allowMissingColumns=True)
    rows = table.collect()
    want = brute.languages([r.text for r in rows], [(r.text, r.lang) for r in rows if r.doc_id is None or r.doc_id % 3])
    profiles = materialize(language.fit(table.where("doc_id is null or doc_id % 3 <> 0")))
    got = language.predict(table, profiles).collect()
    as_rows = lambda found: sorted(((i, p, round(s, 9)) for i, p, s in found), key=str)
    assert as_rows((r.doc_id, r.lang_pred, r.score) for r in got) == as_rows((r.doc_id, *w) for r, w in zip(rows, want, strict=True))


def test_language_ranks_are_those_of_a_plain_count():
    texts = ["Ab ab, ba!", "", "\0a\0", "x1y"]
    doc, gram, count = language._ranked(texts)
    got = collections.Counter()
    for d, g, n in zip(doc.tolist(), gram.tolist(), count.tolist()):
        got[d, "".join(chr(c) for c in ((g >> 42) & 0x1FFFFF, (g >> 21) & 0x1FFFFF, g & 0x1FFFFF) if c)] = n
    want = collections.Counter()
    for d, t in enumerate(texts):
        s = " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " "
        s = re.sub(" +", " ", s)
        for n in (1, 2, 3):
            want.update((d, s[i : i + n]) for i in range(len(s) - n + 1) if s[i : i + n].strip())
    assert got == want


def test_mix(spark, docs):
    random.seed(4)
    for _ in range(60):
        w = {f"s{i}": random.randint(1, 60) for i in range(random.randint(1, 12))}
        total, have = sum(w.values()), collections.Counter()
        for t, s in enumerate(mixing.period(w), 1):
            have[s] += 1
            assert all(abs(have[x] - t * w[x] / total) < 1 for x in w)
        assert have == w
    mixed = mixing.mix(docs, block=4)
    rows = sorted(mixed.collect(), key=lambda r: (r.mix_slot, r.mix_row))
    assert len(rows) == docs.count() and mixed.columns == [c for c in docs.columns if c != "mix_slot"] + ["mix_source", "mix_block", "mix_slot", "mix_row"]
    assert sorted({r.mix_slot for r in rows}) == list(range(max(r.mix_slot for r in rows) + 1))
    sizes = collections.Counter(r.mix_source for r in rows)
    weights, total = mixing.weights_of(sizes), 0
    total, have = sum(weights.values()), collections.Counter()
    order = list(dict.fromkeys((r.mix_source, r.mix_block) for r in rows))
    for t, (s, _) in enumerate(order, 1):  # while all sources have blocks, none is a block away from its share
        have[s] += 1
        assert all(abs(have[x] - t * weights[x] / total) < 1 for x in weights)
        if have[s] == -(-sizes[s] // 4):
            break
    assert mixing.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, weights={"src0": 0})


def test_katz_answers_are_one_row_a_run_and_bucket(spark, docs, monkeypatch):
    """Not one a text and bucket, whose number grows with the product of both."""
    monkeypatch.setattr(katz, "PER_BUCKET", 200)
    made = katz.score_texts(docs, F.expr("doc_id % 7 <> 2"))
    assert made.count() == docs.count()
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    answer = next(line for line in plan.splitlines() if "FlatMapCoGroupsInArrow" in line)
    assert re.search(r"\[rid#\d+L, docs#\d+, part#\d+\]", answer), answer


def test_hash_powers_grow_to_what_is_asked_for(monkeypatch):
    """Not to twice what was there: blocks of slightly different sizes kept 64 MB a worker."""
    for name in ("_powers", "_inverse"):
        monkeypatch.setattr(text, name, np.ones(1, np.uint64))
    for n in (2_000_001, 2_000_500, 2_090_000):
        p, inv = text.powers(n)
        assert n <= len(p) == len(inv) <= 1 << 21
    assert (p[1:] == p[:-1] * p[1]).all() and (p * inv == 1).all()


def test_katz_widens_words_a_run_at_a_time(monkeypatch):
    """Word numbers of a batch stay as narrow as they are stored, but for the run at hand."""
    monkeypatch.setattr(katz, "FLUSH", 1000)
    ids = pa.array([list(range(k, k + 500)) for k in range(100)], pa.list_(pa.int32()))
    runs = list(katz._flushes(iter([pa.RecordBatch.from_arrays([pa.array(range(100)), ids], ["rid", "ids"])]), 1 << 30))
    assert [r[0] for r in runs] == list(range(0, 100, 2)) and all(r[1].base is None and len(r[1]) == 1000 for r in runs)
    assert np.array_equal(np.concatenate([r[1] for r in runs]), np.asarray(ids.flatten()).astype(np.int64))


def test_shared_suffixes():
    """Only suffixes that share their first symbols are sorted on, as the whole suffix array has them; rows are not crossed."""
    random.seed(4)
    for it in range(200):
        depth = random.choice([1, 2, 3, 7, 20, 100])
        parts = ["".join(random.choice("ab" if it % 2 else "abcdefgh") for _ in range(random.randint(0, 2 * depth))) for _ in range(4)]
        rows = ["".join(random.choice(parts) for _ in range(random.randint(0, 4))).encode() for _ in range(random.randint(1, 6))]
        data = np.frombuffer(b"".join(rows), np.uint8)
        left = np.concatenate([np.arange(len(r), 0, -1) for r in rows])
        sa, new = shared_suffixes(data, left, depth)
        whole = b"".join(rows)
        here = [(whole[i : i + depth], i) for i in range(len(whole)) if left[i] >= depth]
        times = collections.Counter(x for x, _ in here)
        want = sorted(x for x in here if times[x[0]] > 1)
        assert sa.tolist() == [i for _, i in want]
        assert new.tolist() == [k == 0 or want[k - 1][0] != want[k][0] for k in range(len(want))]


def test_suffixes_that_share_nothing_are_not_sorted_on(monkeypatch):
    """Neighbourhoods share little but their anchor, so after the first rounds few positions are left to sort."""
    rng = np.random.default_rng(3)
    rows = [np.r_[rng.integers(97, 123, 60), np.full(40, 65 + k % 20), rng.integers(97, 123, 60)].astype(np.uint8) for k in range(400)]
    sorted_, real = [], suffix._sorted

    def count(value, at, low, bits):
        sorted_.append(len(at))
        return real(value, at, low, bits)

    monkeypatch.setattr(suffix, "_sorted", count)
    data, left = np.concatenate(rows), np.tile(np.arange(160, 0, -1), 400)
    assert len(suffix.shared_suffixes(data, left, 100)[0]) == 0
    assert sorted_[0] <= len(data) and sum(sorted_[1:]) < 0.8 * len(data)


def test_repeats_lets_go_of_what_later_steps_do_not_read(spark, docs, monkeypatch):
    """The table of hashes goes once texts are chosen, and all that only tells the removed runs once these are stored."""
    steps = []

    def store(df, *how):
        out = materialize(df, *how)
        steps.append(out._scratch_path)
        return out

    monkeypatch.setattr(repeats, "materialize", store)
    real = repeats.release
    monkeypatch.setattr(repeats, "release", lambda session: (steps.append("release"), real(session)))
    found = repeats.remove_repeats(docs)
    tables = [x for x in steps if x != "release"]
    assert [os.path.exists(x) for x in tables] == [False, True, False, False, False, True]  # the texts and their removed runs stay
    assert steps.index("release") < steps.index(tables[-1])
    assert found.count() == docs.count()
