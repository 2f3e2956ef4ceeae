"""Quality rules, line dedup and fingerprints against plain Python, with odd rows in every fixture."""

import hashlib
import re
from collections import Counter

import pytest

from lucerna.llm import common, fingerprints, line_dedup, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LONG = " ".join(f"w{i % 97} x{i % 89}" for i in range(30_000))
TEXTS = [
    (0, "one two three one two three one two three", "a"),
    (1, None, "a"),
    (2, "", None),
    (3, "  \t\n\x0b ", "b"),
    (4, "#a *b\n#a *b\n\n  #a *b \nc & d < e > f | g $ %", "b"),
    (5, " ".join(f"w{i}" for i in range(60)), "a"),
    (6, " ".join(["the cat sat"] * 40), "a"),
    (7, LONG, "c"),
    (8, "naïve café — ünïcode \U0001f600 words \u00a0nbsp", "c"),
    (8, "naïve café — ünïcode \U0001f600 words \u00a0nbsp", "c"),
    (None, "no id here", None),
    (9, "Shared Line Number One\n  shared line number one\nown line of nine", "a"),
    (10, "x\nSHARED LINE NUMBER ONE\t\nshared line number one\nlast", "a"),
    (11, "shared line number one", "a"),
    (12, "tiny\ntiny\nshort one", "a"),
    (13, "tiny\nshort one", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, source string")
    # columns whose names clash with those that operators make
    return df.selectExpr("*", "1 AS id", "'x' AS base", "2 AS kept", "3 AS row", "4 AS host")


def metrics(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_metrics(docs):
    out = quality_rules.quality_rules(docs).collect()
    assert len(out) == len(TEXTS)
    found = sorted(((r["doc_id"] is None, r["doc_id"] or 0, *r[1:7]) for r in out), key=str)
    assert found == sorted(((d is None, d or 0, *metrics(t)) for d, t, _ in TEXTS), key=str)
    assert all(not r["kept"] for r in out if r["base_failed"])


def test_host_verdicts_shrink_to_the_prior(spark):
    rows = [("good", i % 10 == 0) for i in range(200)] + [("bad", i % 10 != 0) for i in range(200)] + [("rare", True)] + [(None, False)] * 20
    got = {r["host"]: r for r in quality_rules.host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()}
    assert got["good"]["host_ok"] and not got["bad"]["host_ok"] and got[None]["host_ok"]
    assert 0.4 < got["rare"]["rate"] < 1 and abs(got["good"]["rate"] - 0.1) < 0.02
    assert quality_rules.host_verdicts(spark.createDataFrame([], "host string, base_failed boolean")).collect() == []


def test_kept_rows_keep_columns(docs):
    out = quality_rules.kept_rows(docs)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} <= {5, 7}


def deduped(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    holders = {}
    big = common.LAST_ID
    for d, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(big if d is None else d)
    out = []
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        keep = [len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == (big if d is None else d) for x in lines]
        kept = "\n".join(x for x, k in zip(lines, keep, strict=True) if k)
        runs, state = [0], True
        for k in keep:
            if k != state:
                runs.append(0)
                state = k
            runs[-1] += 1
        if not state:
            runs.append(0)
        out.append((str(d), len(lines), len(lines) - sum(keep), hashlib.sha256(kept.encode()).hexdigest(), str(runs)))
    return sorted(out)


def test_line_dedup(docs):
    out = line_dedup.line_dedup(docs).selectExpr("row.doc_id", "n_lines", "n_dropped", "sha2(kept, 256)", "keep_runs").collect()
    assert sorted((str(r[0]), r[1], r[2], r[3], str(list(r[4]))) for r in out) == deduped(TEXTS)


def test_line_dedup_of_a_very_frequent_line(spark):
    rows = [(i, f"own text number {i}\ncommon line everywhere\nend {i} end {i}", "s") for i in range(300)]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"), salts=4).selectExpr("row.doc_id", "n_dropped").collect()
    assert sorted(map(tuple, out)) == [(i, int(i > 0)) for i in range(300)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert quality_rules.quality_rules(none).collect() == [] and line_dedup.line_dedup(none).collect() == [] and fingerprints.edited_fingerprints(none).collect() == []


def test_fingerprints(docs):
    out = fingerprints.edited_fingerprints(docs).collect()
    assert len(out) == len(TEXTS)
    by_text = {}
    ids = {}
    for d, t, _ in TEXTS:
        ids[d] = t or ""
    for r in out:
        by_text.setdefault(ids[r["doc_id"]], set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and r["n_chars"] == len(ids[r["doc_id"]])
    # equal texts have equal fingerprints; so have texts of the same terms, as these two
    assert all(len(v) == 1 for v in by_text.values()) and by_text[TEXTS[-1][1]] == by_text[TEXTS[-2][1]]
    assert len({min(v) for v in by_text.values()}) == len({frozenset(re.findall(r"\w+", t.lower())) for t in by_text})
    # descending ids, the null id first, then around to the first again
    order = sorted(((common.LAST_ID if d is None else d, t or "") for d, t, _ in TEXTS), key=lambda x: -x[0])
    expected = set()
    for i, (_, t) in enumerate(order):
        n = len(t) // 3
        expected.add(hashlib.sha256((t[: len(t) - n] + order[(i + 1) % len(order)][1][:n]).encode()).hexdigest())
    assert {r["edited_sha256"] for r in out} == expected


def test_next_document_across_buckets(spark):
    ids = [0, 1, 5, 1023, 1024, 5000, 10**12, -7]
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    out = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.edited_fingerprints(df).collect()}
    down = sorted(ids, reverse=True)
    for i, d in enumerate(down):
        t, n = f"text {d}", len(f"text {d}") // 3
        assert out[d] == hashlib.sha256((t[: len(t) - n] + f"text {down[(i + 1) % len(down)]}"[:n]).encode()).hexdigest()


def test_likeness_follows_similarity(spark):
    words = [f"term{i}" for i in range(400)]
    base = [(i, " ".join(words[(i * 37 + k) % 400] for k in range(120))) for i in range(60)]
    near = (1000, base[0][1].replace("term7 ", "other "))
    out = fingerprints.fingerprints(spark.createDataFrame([*base, near], "doc_id long, text string"), fingerprints.IMatch(idf_band=(0.0, 6.9)))
    got = {r["doc_id"]: r["fingerprint"] for r in out.collect()}
    df = spark.createDataFrame([(got[0], got[1000], got[30])], "a string, b string, c string")
    near_s, far_s, same = df.select(fingerprints.likeness(df.a, df.b), fingerprints.likeness(df.a, df.c), fingerprints.likeness(df.a, df.a)).first()
    assert same == 1.0 and near_s > 0.6 and far_s < 0.3


def spark_hash(value, seed=42):
    """xxhash64 of Spark for strings, longs and arrays of longs."""
    import xxhash

    if isinstance(value, list):
        for v in value:
            seed = spark_hash(v, seed)
        return seed
    data = value.encode() if isinstance(value, str) else (value & (2**64 - 1)).to_bytes(8, "little")
    return xxhash.xxh64(data, seed=seed & (2**64 - 1)).intdigest()


def test_fingerprints_against_a_plain_version(spark):
    """Terms, the band, all hashed subsets and their hashes, computed term by term."""
    import math
    import random

    rng = random.Random(6)
    docs = [(i, " ".join(f"T{int(rng.paretovariate(0.6)) % 900}" for _ in range(rng.randint(1, 400)))) for i in range(120)] + [(500, None), (501, "!?")]
    p = fingerprints.IMatch(idf_band=(0.5, 3.0))
    out = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(spark.createDataFrame(docs, "doc_id long, text string"), p).collect()}
    terms = {d: set(re.findall(r"[^\W_]+", (t or "").lower())) for d, t in docs}
    df = {}
    for own in terms.values():
        for t in own:
            df[t] = df.get(t, 0) + 1
    low, high = p.idf_band
    for d, own in terms.items():
        kept = sorted(t for t in own if low <= math.log(len(docs) / df[t]) <= high) or sorted(own)
        hashes, parts = [spark_hash(t) for t in kept], []
        for row in fingerprints.SUBSET_BITS:
            first = 0
            for bits in row:
                chosen = [h for h in hashes if (h >> first) & ((1 << bits) - 1) == 0]
                parts.append(f"{spark_hash(chosen):x}" if chosen else "-")
                first += bits
            hashes = [spark_hash(h) for h in hashes]
        assert out[d] == ":".join(parts)


def test_next_documents_of_many_null_and_equal_ids(spark):
    import xxhash

    rows = [(None if i % 2 else 7 if i % 3 else i * 10**9, f"text number {i} of them") for i in range(400)]
    out = fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    signed = lambda t: xxhash.xxh64(t.encode(), seed=42).intdigest() - (2**64 if xxhash.xxh64(t.encode(), seed=42).intdigest() >= 2**63 else 0)
    down = sorted(((common.LAST_ID if d is None else d, t) for d, t in rows), key=lambda r: (-r[0], signed(r[1])))
    expected = sorted(hashlib.sha256((t[: len(t) - len(t) // 3] + down[(i + 1) % len(down)][1][: len(t) // 3]).encode()).hexdigest() for i, (_, t) in enumerate(down))
    assert sorted(r["edited_sha256"] for r in out) == expected
