"""Whitening, WARC archives and periodic runs against brute force, and their awkward inputs."""

import base64
import glob
import gzip
import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import periodic, warc, whitening
from spanforge.llm.stage import shared_dir

VECTORS = "vec_id long, embedding array<float>, component int, x int, n string"
PAGES = "page_id long, url string, html string, record_id string, n int, archive string, digest string"


def vectors(seed=3, n=160, dim=12):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, dim)) @ (rng.standard_normal((dim, dim)) * rng.random(dim))
    return [(k, [float(np.float32(c)) for c in v], 1, 2, "x") for k, v in enumerate(m)]


def by_eigh(rows):
    x = np.array([np.floor(1024 * np.array(v)) + 100_000 for v in rows])
    n = len(x)
    e, u = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    e, u = e[::-1], u[:, ::-1]
    total = [int(s) for s in x.sum(0)]
    deviation = [sum((n * int(c) - s) ** 2 for c, s in zip(r, total)) for r in x]
    return (x - x.mean(0)) @ u[:, :8] / np.sqrt(e[:8]), e[:8] / e.sum(), deviation


def test_whitening_equals_an_eigensolver(spark):
    rows = vectors()
    odd = [(900, None, 1, 1, ""), (901, [], 1, 1, ""), (902, [float("nan")] * 12, 1, 1, ""), (903, [1.0] * 11 + [None], 1, 1, ""), (904, [float("inf")] * 12, 1, 1, ""), (905, [3e38] * 12, 1, 1, "")]
    # A row that comes twice counts twice; a null id stays.
    given = rows + [rows[4], (None, rows[7][1], None, None, None)]
    got = whitening.whiten(spark.createDataFrame(given + odd, VECTORS).repartition(5)).toPandas()
    want, share, deviation = by_eigh([r[1] for r in given])
    assert len(got) == 8 * len(given) and set(got.columns) == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    assert (got["n"] == len(given)).all() and got["identity_error"].max() < 1e-10
    first = got[got["vec_id"].notna()].drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    sign = np.sign((first * want[: len(rows)]).sum(0))
    assert np.abs(first * sign - want[: len(rows)]).max() < 1e-9
    assert np.allclose(got.groupby("component")["explained"].first(), share, rtol=1e-10)
    exact = got[got["component"] == 1].dropna(subset=["vec_id"]).drop_duplicates("vec_id").sort_values("vec_id")["deviation"]
    assert [int(d) for d in exact] == deviation[: len(rows)]
    assert got["vec_id"].isna().sum() == 8


def test_whitening_does_not_depend_on_partitions(spark):
    table = spark.createDataFrame(vectors(5), VECTORS)
    a, b = (whitening.whiten(table.repartition(p)).orderBy("vec_id", "component").toPandas() for p in (1, 7))
    # The covariance is exact; only the check of the result is rounded by the order of its sums.
    assert a.drop(columns="identity_error").equals(b.drop(columns="identity_error")) and a["identity_error"].max() < 1e-12


def test_a_projection_does_not_depend_on_its_neighbours():
    rng = np.random.default_rng(0)
    y, onto = rng.integers(-4000, 4000, (160, 12)).astype(float), rng.standard_normal((12, 8))
    assert (whitening.projected(y, onto) == np.vstack([whitening.projected(p, onto) for p in np.array_split(y, 7)])).all()
    assert np.allclose(whitening.projected(y, onto), y @ onto)


def test_whitening_of_awkward_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    same = [(k, [1.0, 2.0, 3.0], 1, 1, "") for k in range(5)]
    assert whitening.whiten(spark.createDataFrame(same, VECTORS)).count() == 0
    # One direction only: one component; two lengths: two populations.
    line = [(k, [float(k), 2.0 * k, 0.0], 1, 1, "") for k in range(6)] + [(10 + k, [float(k * k), 1.0], 1, 1, "") for k in range(4)]
    got = whitening.whiten(spark.createDataFrame(line, VECTORS)).toPandas()
    assert len(got) == 10 and set(got["component"]) == {1} and set(got["n"]) == {6, 4} and np.allclose(got["explained"], 1)
    # Numbers whose squares pass 64 bits.
    big = [(k, [float(np.float32(1e9 * (k % 3))), float(np.float32(7e8 * (k % 4)))], 1, 1, "") for k in range(12)]
    got = whitening.whiten(spark.createDataFrame(big, VECTORS)).filter("component = 1").orderBy("vec_id").toPandas()
    assert [int(d) for d in got["deviation"]] == by_eigh([r[1] for r in big])[2]


@pytest.mark.parametrize("values", [np.full(6, 2.0), np.r_[np.full(5, 3.0), np.full(7, 1.0)], 10.0 ** -np.arange(16.0), np.arange(9.0) - 4, np.zeros(4), 1 + 1e-9 * np.arange(20)])
def test_spectral_division(values):
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((len(values),) * 2))[0]
    a = (q * values) @ q.T
    found = list(whitening.components(a, len(values)))
    if not values.any():
        assert not found
        return
    e, v = np.array([e for e, _ in found]), np.stack([v for _, v in found], 1)
    assert np.abs(e - np.sort(values)[::-1]).max() < 1e-14 * np.abs(values).max() * len(values)
    assert np.abs(v.T @ v - np.eye(len(values))).max() < 1e-13 and np.abs(a @ v - v * e).max() < 1e-13 * np.abs(values).max()


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    d = np.r_[rng.random(11) + 1e-7, -rng.random(19) * 1e5 - 1e-7]
    assert np.abs(whitening.polar((q * d) @ q.T) - (q * np.sign(d)) @ q.T).max() < 1e-7


def pages():
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefghij <>\n\r") for _ in range(3_000_000))
    texts = ["<p>a</p>", "é" * 50, "", None, "<p>a</p>", "x\r\n\r\ny", long, "", "WARC/1.1\r\n\r\n", long, "<p>a</p>"]
    rows = [(k, f"http://e.x/{k}?q=a b\r\nc%20ü", t, "r", 1, "a", "d") for k, t in enumerate(texts)]
    return rows + [(2, None, "other text, same id", None, None, None, None), rows[0], (None, "u", "<p>a</p>", None, None, None, None), (None, "u", "alone", None, None, None, None)]


def test_pages_come_back_from_archives(spark):
    rows = pages()
    table = spark.createDataFrame(rows, PAGES).repartition(3)
    got = warc.page_records(table).collect()
    first = {}
    for page, _, html, *_ in rows:
        body = (html or "").encode()
        first[body] = min(first.get(body, (True, 0)), (page is None, page or 0))
    want = []
    seen = set()
    for page, url, html, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (html or "").encode()
        response = body not in seen
        seen.add(body)
        least = None if first[body][0] else first[body][1]
        uri = url and url.replace(" ", "%20").replace("\r", "%0D").replace("\n", "%0A")
        want.append((page, uri, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if response else "revisit", None if response else least))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_small_payloads_are_all_responses(spark):
    table = spark.createDataFrame([(k, "u", "tiny", "", 1, "", "") for k in range(4)] + [(9 - k, "u", "long enough", "", 1, "", "") for k in range(3)], PAGES)
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.page_records(table, least_bytes=5).collect()}
    assert got == {(k, "response", None) for k in range(4)} | {(7, "response", None), (8, "revisit", 7), (9, "revisit", 7)}


def test_keys_of_many_rows_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(warc, "HEAVY_ROWS", 3)
    table = spark.createDataFrame([(k, "u", f"t{k % 2 if k < 9 else k // 2}", "", 1, "", "") for k in range(20)], PAGES)
    got = {r["page_id"]: r["refers_to"] for r in warc.page_records(table).collect()}
    assert got == {k: (k % 2 if 2 <= k < 9 else k - 1 if k > 9 and k % 2 else None) for k in range(20)}


def test_files_are_plain_warc(spark):
    at = warc.archive_pages(spark.createDataFrame(pages(), PAGES).coalesce(1)).removeprefix("file:")
    archive = glob.glob(f"{at}/*.warc.gz")[0]
    raw = open(archive, "rb").read()
    entries = [json.loads(line) for line in open(f"{archive}.idx")]
    assert entries[0]["record_type"] == "warcinfo" and len(entries) == len(pages()) + 1
    for e in entries:  # each record is a whole member by itself
        one = gzip.decompress(raw[e["offset"] : e["offset"] + e["length"]])
        assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n") and e["record_id"].encode() in one
    assert sum(e["length"] for e in entries) == len(raw)
    bodies = warc.read_records(spark, at, payloads=True).filter("record_type = 'response'").select("payload").collect()
    assert {bytes(b["payload"]) for b in bodies} == {(r[2] or "").encode() for r in pages()}


def test_foreign_monolith_is_normalised(spark, tmp_path):
    record = lambda k, kind, block: (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{k}>\r\nX-Long: a\r\n  b\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    blocks = [http + b"one", b"no http at all", http, http + b"x" * 5_000_000]
    data = b"".join(record(k, "response" if k != 1 else "metadata", b) for k, b in enumerate(blocks))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(data))
    to = f"{shared_dir(spark)}/foreign-{random.random()}"
    archives = spark.createDataFrame([(str(tmp_path / "a.warc.gz"), None)], "archive string, changes array<struct<nth:bigint,refers_to:string>>")
    assert warc.normalise(archives, to) == 1 == warc.normalise(archives, to)
    got = {r["record_id"]: (r["record_type"], r["payload_bytes"]) for r in warc.read_records(spark, to).collect()}
    assert got == {"<urn:0>": ("response", 3), "<urn:2>": ("response", 0), "<urn:3>": ("response", 5_000_000)}
    assert gzip.open(f"{to}/a.warc.gz").read() == data.replace(b"WARC/1.0", b"WARC/1.1").replace(b"X-Long: a\r\n  b", b"X-Long: a b")
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data[:-9]))
    with pytest.raises(ValueError):
        warc.rewrite(str(tmp_path / "b.warc.gz"), str(tmp_path / "out.warc.gz"), {})


def test_empty_pages(spark):
    got = warc.page_records(spark.createDataFrame([], PAGES))
    assert got.count() == 0 and got.columns == ["page_id", "target_uri", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def brute_runs(words):
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                s = words[i : j + q]
                if not any(s[d:] == s[:-d] for d in range(1, q)):
                    out.append((i, len(s), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 5)):
            words = []
            for _ in range(rng.randint(0, 5)):
                words += [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(1, 9))] * rng.randint(1, 7) + [rng.randrange(8) for _ in range(rng.randint(0, 3))]
                if rng.random() < 0.4:
                    words += words[-rng.randint(1, len(words)) :] * rng.randint(1, 4)
            docs.append(words[:150])
        bounds = np.append(0, np.cumsum([len(d) for d in docs])).astype(np.int64)
        got = periodic.runs(np.array(sum(docs, []), np.int64), bounds)
        assert got.tolist() == [[int(bounds[k]) + s, n, q] for k, d in enumerate(docs) for s, n, q in brute_runs(d)]


def test_no_period_is_lost_in_long_texts():
    rng = np.random.default_rng(6)
    for q in (1, 2, 7, 400, 999):
        unit = rng.integers(0, 5000, q)
        text = np.concatenate([rng.integers(0, 5000, 300), np.tile(unit, 9)[: 4 * q + 5], rng.integers(0, 5000, 200)])
        assert any(p == q and 4 * q <= n <= 4 * q + 9 for _, n, p in periodic.runs(text, np.array([0, len(text)])).tolist())
    assert periodic.runs(np.zeros(200_000, np.int64), np.array([0, 200_000])).tolist() == [[0, 200_000, 1]]


DOCS = "doc_id long, text string, runs string, best int, h int, collapsed string"


def by_hand(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    drop = {k for s, length, q in found for k in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else None
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *shown, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(), hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in drop)).hexdigest())


def test_digests_of_runs(spark):
    rng = random.Random(9)
    words = ["ab", "cd", "é", "x y", "z\u0085"]
    rows = [(k, " ".join(rng.choice(words[: rng.randint(1, 5)]) for _ in range(rng.randint(0, 80))), "r", 1, 2, "c") for k in range(120)]
    rows += [(200, None, None, None, None, None), (201, "", "", 1, 1, ""), (None, "la la la la la la la", "", 1, 1, ""), rows[3], (202, "a b " * 3000 + "\tc\x0b" * 500, "", 1, 1, "")]
    got = periodic.summarise(periodic.detect(spark.createDataFrame(rows, DOCS).repartition(3), planted=True, digest=True)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((by_hand(r[0], r[1]) for r in rows), key=repr)
    plain = periodic.detect(spark.createDataFrame([(1, "w " * 9 + "end", "", 1, 1, "")], DOCS)).first()
    assert plain["collapsed"] == b"w end" and [tuple(r) for r in plain["runs"]] == [(0, 9, 1)] and plain["n_words"] == 10
    assert periodic.detect(spark.createDataFrame([], DOCS)).count() == 0


def test_slices_do_not_matter(spark, monkeypatch):
    table = spark.createDataFrame([(k, f"{k} " + "u v w " * k, "", 1, 1, "") for k in range(30)], DOCS).coalesce(1)
    whole = periodic.detect(table).orderBy("doc_id").collect()
    monkeypatch.setattr(periodic, "SLICE_WORDS", 10)
    assert periodic.detect(table).orderBy(F.col("doc_id")).collect() == whole
