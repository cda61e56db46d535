"""The opN_ queries on a whole small table against plain Python, and the odd rows that operators promise to survive."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from verdigris.llm import ann, packing, queries, secretscan, suffixdedup, tokencounts

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def base_spans(text):
    out = []
    for order, (kind, pattern, test) in enumerate((
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 16),
    )):
        out += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text) if test(m)]
    return sorted(out)


def most_entropy(hit, window):
    def of(part):
        return -sum(c / window * math.log2(c / window) for c in collections.Counter(part).values())

    return max(of(hit[i : i + window]) for i in range(len(hit) - window + 1))


def entropy_spans(text, base, rules):
    found = []
    for m in re.finditer(f"[A-Za-z0-9+/_=-]{{{rules.least},}}", text):
        hit = m[0]
        bits = rules.hex_bits if re.fullmatch("[0-9a-fA-F]+", hit) else rules.alnum_bits if re.fullmatch("[A-Za-z0-9]+", hit) else rules.base64_bits
        if re.search("[0-9]", hit) and re.search("[A-Za-z]", hit) and not any(re.search(p, hit) for p in rules.allow) and most_entropy(hit, rules.window) >= bits:
            if not any(b[0] < m.end() and m.start() < b[2] for b in base):
                found.append((m.start(), 3, m.end(), "entropy"))
    return found


def masked(text, spans):
    out, at = "", 0
    for start, _, end, _ in spans:
        if start >= at:
            out += text[at:start] + "<secret>"
        at = max(at, end)
    return out + text[at:]


def test_op2(spark, texts):
    for r in queries.op2_secret_scan(spark, SF).collect():
        base = base_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b[3] == k for b in base) for k in ("assign", "access", "hex")) and r.base_sha256 == sha(joined)


def test_secrets_and_entropy(spark):
    """Generated texts: spans, entropy by a direct count, and the masked text; long runs and many spans take seconds."""
    rng, rules = random.Random(4), secretscan.EntropyRules()
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    made = ["", "é🙂 " + "".join(rng.choices(letters, k=40)), "0123456789abcdefapi_key=ABCDEFGHIJKL1234 x", "x" * 70_000 + " " + "".join(rng.choices(letters, k=30)) + " " + "ü" * 70_000 + " deadbeefdeadbeef0"]
    for _ in range(60):
        parts = [rng.choice(["".join(rng.choices(letters + "+/_=-", k=rng.randint(10, 60))), "%x" % rng.getrandbits(rng.randint(20, 200)), "AKIA" + "".join(rng.choices(letters[:26], k=rng.randint(10, 20))), "secret = '" + "".join(rng.choices(letters, k=rng.randint(8, 30))), "wörd", "🙂", "aaaa" * rng.randint(1, 12) + "1"]) for _ in range(rng.randint(1, 30))]
        made.append(rng.choice(["", " ", "\n"]).join(parts))
    made.append(" ".join("%016x" % rng.getrandbits(64) for _ in range(1500)))  # more spans than a block
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    hits = 0
    for r in secretscan.scan_secrets(docs).collect():
        base = base_spans(made[r.doc_id])
        assert [tuple(s) for s in r.base] == base
        want = sorted(base + entropy_spans(made[r.doc_id], base, rules))
        assert [tuple(s) for s in r.spans] == want
        hits += len(want) - len(base)
    assert hits > 50
    for r in secretscan.mask_secrets(docs).collect():
        base = base_spans(made[r.doc_id])
        assert r.text == masked(made[r.doc_id], sorted(base + entropy_spans(made[r.doc_id], base, rules)))
    long = spark.createDataFrame([(1, "".join(rng.choices(letters, k=300_000))), (2, " ".join("%016x" % rng.getrandbits(64) for _ in range(40_000)))], "doc_id long, text string")
    assert {r.doc_id: len(r.spans) for r in secretscan.scan_secrets(long).collect()} == {1: 1, 2: 40_000}
    assert {r.doc_id: r.n for r in secretscan.mask_secrets(long).select("doc_id", F.length("text").alias("n")).collect()} == {1: 8, 2: 40_000 * 9 - 1}


LONG_RUNS = {  # a million characters that reach each pattern, and how many spans they hold
    "a" + "-b1" * 333_333: 0, "a" + "-b1" * 333_333 + "-": 0, "k=v1" + "_Zz9" * 250_000: 0, "q" * 40 + "1" + "0" * 1_000_000: 1, "1Example" + "b7" * 500_000: 1, "1" + "/abc" * 250_000: 0, "9qwertyui" * 110_000: 0,
    "AKIA" + "A1" * 500_000: 1, "0123456789abcdef" * 62_500: 1, "token: " + "-b1" * 333_333: 1, "secret" + "=" * 1_000_000 + " ": 1, "password" + " " * 1_000_000: 0,
}


def test_long_runs(spark):
    """A run of a million characters is scanned and masked without recursion, whichever pattern it meets."""
    docs = spark.createDataFrame(list(enumerate(LONG_RUNS)), "doc_id long, text string")
    assert {r.doc_id: len(r.spans) for r in secretscan.scan_secrets(docs).collect()} == dict(enumerate(LONG_RUNS.values()))
    masked_ids = {r.doc_id for r in secretscan.mask_secrets(docs).where("text LIKE '%<secret>%'").select("doc_id").collect()}
    assert masked_ids == {i for i, n in enumerate(LONG_RUNS.values()) if n}


def test_masking_keeps_other_columns(spark):
    odd = spark.createDataFrame([(1, None, "a", 1), (None, "token: abcdefghijklmnop", "b", 2), (1, "", "c", 3)], "doc_id long, text string, __secrets string, spans int")
    got = secretscan.mask_secrets(odd)
    assert got.columns == odd.columns and sorted(map(tuple, got.collect()), key=lambda r: r[3]) == [(1, None, "a", 1), (None, "<secret>", "b", 2), (1, "", "c", 3)]
    assert secretscan.mask_secrets(odd.where("false")).collect() == []


def test_op4(spark, texts):
    from verdigris.llm import bytebpe

    path = P.path("byte_bpe_multi_50k.tiktoken")
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.byte_bpe(path, P.PATTERN).ranks, special_tokens={})
    for r in queries.op4_byte_bpe(spark, SF).collect():
        ids = theirs.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(texts[r.doc_id]))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def test_op5(spark, texts, tokenizer):
    seen, sequences = collections.defaultdict(dict), collections.Counter()
    for r in queries.op5_packing(spark, SF).collect():
        seen[r.doc_id][r.start] = r
        sequences[r.sequence_id] += 1
        assert r.offset == 0 and r.length == 1 << r.bucket and r.length <= 2048
    assert set(seen) == set(texts) and max(sequences.values()) == 1
    for i, pieces in seen.items():
        ids, at = tokenizer.encode(texts[i], add_special_tokens=False).ids + [1], 0
        for start in sorted(pieces):
            r = pieces[start]
            assert start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)


SPECIAL = ["a <|endoftext|> b", "<|startoftext|>x", "hello<|endoftext|>", "<|ENDOFTEXT|> A<|endoftext|>B.", "<|endoftext|><|endoftext|>.", "x<|endofTEXT|>y <|startoftext|>,", None, ""]


def test_special_tokens(spark, tokenizer):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    docs = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    for how, theirs in ((False, tokenizer), (True, plain)):
        parts = collections.defaultdict(dict)
        for r in packing.pack_documents(docs, path, plain=how).collect():
            parts[r.doc_id][r.start] = np.frombuffer(r.token_ids, "<u4").tolist()
        for i, text in enumerate(SPECIAL):
            assert sum((parts[i][s] for s in sorted(parts[i])), []) == theirs.encode(text or "", add_special_tokens=False).ids + [1]
    for r in tokencounts.count_tokens(spark, docs.withColumns({"file": F.lit(1), "ordinal": F.lit("x")}), path, 49407).collect():
        assert r.n_tokens == len(plain.encode(SPECIAL[r.doc_id] or "", add_special_tokens=False).ids)


def test_op6(spark, texts):
    got, before = {r.doc_id: r for r in queries.op6_suffix_dedup(spark, SF).collect()}, set()
    assert set(got) == set(texts)
    for i in sorted(texts):
        b = texts[i].encode()
        own = [b[j : j + 50] for j in range(len(b) - 49)]
        gone = np.zeros(len(b) + 1, bool)
        for j, w in enumerate(own):
            if w in before:
                gone[j : j + 50] = True
        before.update(own)
        gone = gone[: len(b)]
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), spans, sha(bytes(np.frombuffer(b, np.uint8)[~gone])))


def test_rewritten_is_what_is_kept(spark):
    shared = "this passage of more than fifty bytes stands in several of these documents, ünd so it goes "
    rows = [(1, "aa " + shared + "bb", "n"), (2, "cc " + shared + "dd", "m"), (3, None, "x"), (None, shared, "y"), (2, "cc " + shared + "dd", "z"), (5, shared, "w"), (6, "", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __repeat_id string")
    kept = collections.Counter((r.doc_id, bytes(r.kept).decode("utf-8", "ignore")) for r in suffixdedup.remove_repeats(spark, docs).collect())
    got = suffixdedup.SuffixDedup(spark, docs).rewritten(docs, "doc_id", "text")
    assert got.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text or "") for r in got.collect()) == kept
    assert collections.Counter(r["__repeat_id"] for r in got.collect()) == collections.Counter(r[2] for r in rows)
    empty = docs.where("false")
    assert suffixdedup.SuffixDedup(spark, empty).rewritten(empty, "doc_id", "text").collect() == []


def test_op7(spark, texts):
    import zstandard

    press, bands = zstandard.ZstdCompressor(level=3, write_content_size=False), ((200, 0.95, 4.0), (1000, 1.2, 6.0), (4000, 1.5, 8.0), (16000, 1.7, 10.0))
    for r in queries.op7_quality_rules(spark, SF).collect():
        b = texts[r.doc_id].encode()
        verdict = True
        for least, low, high in bands:
            if len(b) >= least:
                verdict = low <= len(b) / len(press.compress(b)) <= high
        if len(b) >= 8192:
            cuts = list(range(0, len(b) - len(b) % 4096, 4096))
            parts = [b[c : (len(b) if c == cuts[-1] else c + 4096)] for c in cuts]
            verdict = verdict and sum(not 1.3 <= len(p) / len(press.compress(p)) <= 12.0 for p in parts) <= 0.34 * len(parts)
        assert r.kept == (verdict and not r.base_failed)


def test_op10(spark, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    assert {r.doc_id: r.n_tokens for r in queries.op10_token_counts(spark, SF).collect()} == {i: len(plain.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


def nearest(spark, vectors, k=20, kind="double", **params):
    rows = [(i, v, "q") for i, v in vectors]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, query_id string")
    out = collections.defaultdict(list)
    for r in ann.nearest_neighbours(spark, df, F.col("vec_id") % 20 == 0, k, params=ann.CrossPolytope(**params)).orderBy("query_id", "rank").collect():
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def exact(vectors, k=20):
    """Of distinct (id, vector) the k best for each query, ties to the smaller id."""
    held = sorted({(i, tuple(v)) for i, v in vectors})
    out = {}
    for q, v in held:
        if q % 20 == 0:
            best = {}
            for i, u in held:
                if i != q and len(u) == len(v):
                    best[i] = max(best.get(i, -math.inf), sum_in_order(v, u))
            out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return {q: x for q, x in out.items() if x}


def sum_in_order(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


@pytest.mark.parametrize("n", [1, 10, 21])
def test_nearest_of_few(spark, n):
    rng = np.random.default_rng(n)
    vectors = [(i, rng.normal(size=64).tolist()) for i in range(n)]
    assert nearest(spark, vectors) == exact(vectors)


def test_nearest_ties_repeats_and_lengths(spark):
    rng = np.random.default_rng(7)
    twin = rng.integers(-3, 4, 8).astype(float).tolist()
    vectors = [(i, twin) for i in range(0, 60)] + [(i, twin) for i in range(30, 50)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(30)]
    assert nearest(spark, vectors) == exact(vectors)


def test_nearest_by_hashing(spark):
    """Large enough that most queries are answered from buckets, in several blocks: recall, exact scores, and order."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(6_000, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = nearest(spark, [(i, x.tolist()) for i, x in enumerate(v)], kind="float", block_queries=4)
    wide, hit = v.astype(np.float64), 0
    for q in range(0, 6_000, 20):
        scores = wide @ wide[q]
        scores[q] = -9
        hit += len({i for i, _ in got[q]} & set(np.argsort(-scores)[:20].tolist()))
        assert len(got[q]) == 20 and got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
    assert set(got) == set(range(0, 6_000, 20)) and hit / (20 * len(got)) >= 0.9
    assert all(s == sum_in_order(wide[0], wide[i]) for i, s in got[0])
