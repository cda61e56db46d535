"""Resampling, SimHash classes and the divergence audit against plain Python, on a whole small table and on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from verdigris.llm import divergence, queries, resample, simhash

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"Wört{i % 97} und{i % 13}," for i in range(4_000)) + " " + "ä" * 3_000 + "x" * 200
ODD = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "One two", None, None), (3, "one TWO", "en", "b"), (4, "!!! ... \x00\x1f", "en", "b"), (5, LONG, "de", "a"), (5, LONG, "de", "a"), (6, LONG + " end", "de", "b"), (None, "no id at all " * 9, "de", None), (None, None, None, None), (7, "a b c " * 30, "en", "a"), (8, "a b c " * 30, "en", "c"), (9, "İstanbul ſ K ÀÉ 0x1F", "", "")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, s, 1, "z") for i, t, g, s in rows], "doc_id long, text string, lang string, source string, weight int, fp string")


def rows(df):
    return collections.Counter(tuple(r) for r in df.collect())


def drawn(docs, target, buckets=10_000):
    def features(t):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    told = [(i, *features(t)) for i, t in docs]
    s = collections.Counter(b for _, _, f in told for b in f)
    t = collections.Counter(b for x in target for b in features(x)[1])
    total, wanted = s.total(), t.total()
    out = []
    for i, n, f in told:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets)))) for b in f)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    best = sorted((o for o in out if o[5] >= 20 and o[0] is not None), key=lambda o: (-o[3], o[0]))
    for rank, o in enumerate(best[: 5 * len(best) // 100]):
        o[4] = rank + 1
    return collections.Counter(tuple(o[:5]) for o in out)


def test_op11(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows(queries.op11_importance_resampling(spark, SF)) == drawn(docs, target)
    table, wanted = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    assert rows(resample.importance_resample(spark, table, wanted, resample.ResampleParams(chunk_bytes=300))) == drawn(docs, target)


def test_resampling_of_odd_rows(spark):
    """Repeated long rows, chunks, rows without id or text, no target, no rows; the caller's batch size stays."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs, target = frame(spark, ODD), spark.createDataFrame([("one two three",), (None,)], "text string")
    for size in (100, 1 << 16):
        p = resample.ResampleParams(chunk_bytes=size)
        assert rows(resample.importance_resample(spark, docs, target, p)) == drawn([(i, t) for i, t, _, _ in ODD], ["one two three"])
        assert rows(resample.importance_resample(spark, docs, target.where("false"), p)) == drawn([(i, t) for i, t, _, _ in ODD], [])
    assert resample.importance_resample(spark, docs.where("false"), target).collect() == []
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_chunks_own_each_start_once():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["ab", "ü", " ", ".", "\n", "zzzzzzzzzz"]) for _ in range(rng.randint(0, 60))).encode()
        pieces = list(resample.text_chunks(text, rng.randint(1, 20), 2))
        assert [n for n, _, _ in pieces] == list(range(len(pieces))) and sum(owned for _, owned, _ in pieces) == len(text)
        whole = re.findall(rb"[0-9A-Za-z\x80-\xff]+", text)
        seen = collections.Counter()
        for _, owned, piece in pieces:
            words = [(m.start(), m[0]) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", piece)]
            seen.update(tuple(w for _, w in words[i : i + 3]) for i in range(len(words) - 2) if words[i][0] < owned)
        assert seen == collections.Counter(zip(whole, whole[1:], whole[2:]))


def test_checksums_of_words():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in [1, 2, 3, 63, 64, 65, 66, 200, 5_000, 7] * 4]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    crc = resample.word_checksums(data, starts, ends)
    assert crc.tolist() == [zlib.crc32(w) for w in words]
    joined = resample.shifted(crc[:-1], (ends - starts)[1:]) ^ crc[1:]
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in zip(words, words[1:])]


def simhash_of(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_rows(docs):
    prints, least = [(i, simhash_of(t)) for i, t in docs], {i: i for i, _ in docs if i is not None}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    told = [x for x in prints if x[0] is not None]
    for n, (i, f) in enumerate(told):
        for j, g in told[:n]:
            if (f ^ g).bit_count() <= 3:
                a, b = root(i), root(j)
                least[max(a, b)] = min(a, b)
    return collections.Counter((i, f"{f:016x}", None if i is None else root(i)) for i, f in prints)


@pytest.mark.parametrize("block", [1 << 14, 4])
def test_op12(spark, monkeypatch, block):
    """Also with blocks so small that they are cut anew, and dealt out by pairs of parts at last."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows(queries.op12_simhash(spark, SF)) == simhash_rows(docs)


def test_simhash_of_odd_rows(spark):
    docs = frame(spark, ODD)
    assert rows(simhash.simhash_classes(spark, docs)) == simhash_rows([(i, t) for i, t, _, _ in ODD])
    assert simhash.simhash_classes(spark, docs.where("false")).collect() == []
    assert simhash.fingerprint(LONG.encode(), block=50) == simhash.fingerprint(LONG.encode()) == simhash_of(LONG)


def test_gray_index(monkeypatch):
    """Dense groups, several segments, and frontiers that are cut."""
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    rng = np.random.default_rng(2)
    one = np.uint64(1)
    for _ in range(12):
        base = rng.integers(0, 2**63, 6, dtype=np.uint64)
        codes = np.unique(base[rng.integers(0, 6, 250)] ^ (one << rng.integers(0, 64, 250).astype(np.uint64)) ^ (one << rng.integers(0, 24, 250).astype(np.uint64)))
        segment = np.sort(rng.integers(0, 3, len(codes)))
        codes = codes[np.lexsort((simhash.gray_rank(codes), segment))]
        got = simhash.GrayIndex(codes, segment).classes(codes, 3)
        want = np.arange(len(codes))
        for _ in range(len(codes)):
            near = (np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3) & (segment[:, None] == segment[None, :])
            new = np.where(near, want[None, :], len(codes)).min(axis=1)
            if (new == want).all():
                break
            want = new
        assert got.tolist() == want.tolist()


@pytest.mark.parametrize("few, sources", [(1024, 64), (2, 3)])
def test_divergence_of_odd_rows(spark, monkeypatch, few, sources):
    """Repeats make terms kept; null columns are ''; ties by bytes; blocks of few sources; against the SQL."""
    monkeypatch.setattr(divergence, "FEW", few)
    monkeypatch.setattr(divergence, "SOURCES", sources)
    rng = random.Random(3)
    many = [(i, " ".join(rng.choice(["Zeta", "ähm", "ahm", "tie", "TIES", "x1y2", f"w{rng.randint(0, 3)}q"]) for _ in range(rng.randint(0, 8))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "ü", "c", "d", "e", "f", None])) for i in range(500)]
    many += [(1000 + i, " ".join("k" + chr(97 + i // 26 % 26) + chr(97 + i % 26) for i in range(200)), "xx", "big" if i % 2 else "small") for i in range(40)] + [(2000, "kaa", "xx", "small"), (2001, "only", "yy", "one"), (2002, None, "zz", "p"), (2003, None, "zz", "q")]
    table = ODD + many + many[:40]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [list(r) for r in table])
    want = collections.Counter(con.execute(queries.ORACLE_SQL["op13_source_divergence"]).fetchall())
    assert want and rows(divergence.source_divergence(spark, frame(spark, table))) == want
    assert divergence.source_divergence(spark, frame(spark, table).where("false")).collect() == []


def test_terms_of_long_texts(monkeypatch):
    whole = divergence.term_counts(LONG.encode())
    monkeypatch.setattr(divergence, "TEXT_BYTES", 70)
    assert divergence.term_counts(LONG.encode()) == whole and sum(whole.values()) == len(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", LONG))


def test_op13(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert rows(queries.op13_source_divergence(spark, SF)) == collections.Counter(con.execute(queries.ORACLE_SQL["op13_source_divergence"]).fetchall())


def test_divergence_of_sources_without_some_terms(spark, monkeypatch):
    """Shares dealt out in many parts: sources that lack all the terms of a part still meet the others there."""
    monkeypatch.setattr(divergence, "DEAL_ROWS", 8)
    rng = random.Random(5)
    word = lambda i: "w" + chr(97 + i // 26) + chr(97 + i % 26)
    texts = [(i, " ".join(word(5 * (i % 12) + rng.randint(0, 6)) for _ in range(30)), "en" if i % 3 else "de", f"s{i % 12}") for i in range(700)]
    texts += [(1000 + i, t, "en", f"t{i}") for i, t in enumerate(["", "waa", "nothing kept", None])]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [list(r) for r in texts])
    want = collections.Counter(con.execute(queries.ORACLE_SQL["op13_source_divergence"]).fetchall())
    assert want and rows(divergence.source_divergence(spark, frame(spark, texts))) == want
