"""Archives, token files, chats, URLs and the pipeline."""

import hashlib
import io
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from storelens.llm import chat, idcoder, packing, pieces, quality, urls, warc
from storelens.llm.common import text_buffer


# --- archives ------------------------------------------------------------------------------------

PAGES = "page_id bigint, url string, html string, digest string, first bigint, payload_bytes bigint"


def make_pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, 2) for i, u, h in rows], PAGES).repartition(3)


def page_rows():
    long = "<p>é" + "x" * 5000
    return [(5, "http://a/", long), (3, "http://b/\r\nInjected: 1", long), (9, None, long), (4, "http://c", "y" * 99), (6, "u", "y" * 99), (7, "v", "é" * 50), (8, "v", "é" * 50), (1, "w", None), (2, "w", ""), (None, "z", long), (12, "q", "q" * 100), (12, "q", "q" * 100), (13, "r", "q" * 100)]


def brute_archive(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 100 and (h or "") in first and i != first[h]
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return Counter(out)


@pytest.mark.parametrize("chunk", [1 << 20, 700, 1])
def test_archive(spark, chunk):
    rows = page_rows() if chunk > 1 else page_rows()[3:]
    made = warc.write_archive(make_pages(spark, rows), chunk_bytes=chunk)
    got = warc.read_archive(made).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute_archive(rows)
    assert all(len(r["data"]) <= chunk + r.header_bytes + 4 for r in made.collect())


def test_archive_empty_and_file_round_trip(spark):
    assert warc.archived(make_pages(spark, [])).count() == 0
    made = warc.write_archive(make_pages(spark, page_rows()[:10]), chunk_bytes=900)
    stream = io.BytesIO()
    warc.export(made, stream)
    raw = stream.getvalue()
    assert raw.startswith(b"WARC/1.1\r\n") and raw.count(b"WARC/1.1\r\n") == 10 and b"\nInjected" not in raw
    stream.seek(0)
    again = spark.createDataFrame([tuple(map(lambda x: bytearray(x) if isinstance(x, bytes) else x, r)) for r in warc.import_file(stream, 333)], warc.CHUNK_SCHEMA)
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((repr([r[n] for n in names]) for r in warc.read_archive(again).collect())) == sorted(repr([r[n] for n in names]) for r in warc.read_archive(made).collect())


def test_damaged_chunk_is_found(spark):
    from pyspark.sql import functions as F

    made = warc.write_archive(make_pages(spark, page_rows()[:1]), chunk_bytes=700)
    bad = made.withColumn("data", F.when(F.col("chunk_no") == 2, F.encode(F.lit("z" * 700), "UTF-8")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="chunk 2 is damaged"):
        warc.read_archive(bad).collect()
    with pytest.raises(Exception, match="chunk 3 is missing"):
        warc.read_archive(made.where("chunk_no <> 3")).collect()


# --- token files ---------------------------------------------------------------------------------


def coded(spark, ids):
    return idcoder.on_driver(spark, "storelens_encode_ids", np.asarray(ids).astype("<u4").tobytes())


def decoded(spark, blocks):
    return np.frombuffer(idcoder.on_driver(spark, "storelens_decode_ids", blocks), "<u4")


@pytest.mark.parametrize("top", [1, 2, 200, 50257, 1 << 24, 1 << 32])
def test_coder_round_trip(spark, top):
    r = np.random.default_rng(top)
    for n in (0, 1, 255, 3001, 65535, 65536, 65537, 140000):
        ids = np.minimum(r.zipf(1.2, n), top - 1).astype(np.uint32) if n % 2 else r.integers(0, top, n).astype(np.uint32)
        blocks = coded(spark, ids)
        assert (decoded(spark, blocks) == ids).all()
        assert not n or blocks[:4] == b"SLID"
        assert len(blocks) < n * (top.bit_length() / 8 + 0.1) + 32 * (n // 65536 + 1)


def test_blocks_stand_alone(spark):
    ids = np.random.default_rng(5).integers(0, 50, 200_000).astype(np.uint32)
    blocks, at = coded(spark, ids), 0
    for first in range(0, len(ids), 65536):
        n, size = struct.unpack_from("<II", blocks, at + 8)
        assert (decoded(spark, blocks[at : at + 24 + size]) == ids[first : first + n]).all()
        at += 24 + size
    assert at == len(blocks)


def test_coder_compresses_and_checks(spark, sf_dir):
    ids = np.tile(np.arange(50, dtype=np.uint32) * 997 % 50257, 400)
    blocks = coded(spark, ids)
    assert len(blocks) < len(ids) // 8
    for at in (2, 9, 17, 21, 30, len(blocks) - 3):
        bad = bytearray(blocks)
        bad[at] ^= 1
        with pytest.raises(Exception, match="block|checksum"):
            decoded(spark, bytes(bad))
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    ids = np.concatenate([np.array(e.ids, np.uint32) for e in reference_tokenizer().encode_batch(texts, add_special_tokens=False)])
    assert len(coded(spark, ids)) < len(zlib.compress(ids.astype("<u2").tobytes(), 6))


def reference_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    return t


def test_piece_tokenizer_equals_the_library(monkeypatch):
    r = random.Random(4)
    parts = ["a", "bc", "é", " ", "  ", "\n", "\t", "\u00a0", "\x85", ".", "'s", "1", "\u3000", "\u2003", "\u200b", "\x1c", "foo", "<|endoftext|>", "漢", "à", "ʀ"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(4000)] + ["", " ", "x" * 3000]
    ref = [e.ids for e in reference_tokenizer().encode_batch(texts, add_special_tokens=False)]
    data, offsets = text_buffer(pa.array(texts))

    def check(mine, times=2):
        for _ in range(times):
            ids, counts = mine.encode(data, offsets)
            assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == ref

    check(pieces.PieceTokenizer(packing.tokenizer_path()))
    monkeypatch.setattr(pieces, "CACHED_PIECES", 100)
    check(pieces.PieceTokenizer(packing.tokenizer_path()))
    monkeypatch.setattr(pieces, "CACHED_PIECES", 10**6)
    monkeypatch.setattr(pieces, "PROBES", 1)
    check(pieces.PieceTokenizer(packing.tokenizer_path()))
    monkeypatch.setattr(pieces, "hash_ranges", lambda data, a, b: (b - a).astype(np.uint64) << np.uint64(60))
    check(pieces.PieceTokenizer(packing.tokenizer_path()))  # equal hashes of different pieces
    none = pieces.PieceTokenizer(packing.tokenizer_path()).encode(np.zeros(0, np.uint8), np.zeros(3, np.int64))
    assert none[0].tolist() == [] and none[1].tolist() == [0, 0]


def test_piece_tokenizer_keeps_its_memory_in_place():
    import tracemalloc

    mine = pieces.PieceTokenizer(packing.tokenizer_path())
    data, offsets = text_buffer(pa.array([f" {k:x}" for k in range(60000)]))
    first = mine.encode(data, offsets)
    again, small = text_buffer(pa.array([" 1 2f", None, " zzyzx 2f"]))
    tracemalloc.start()
    ids, counts = mine.encode(again, small)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500_000  # no copy of what it remembers, some megabytes
    assert ids.tolist() == [i for e in reference_tokenizer().encode_batch([" 1 2f", "", " zzyzx 2f"], add_special_tokens=False) for i in e.ids] and counts[1] == 0
    assert all(np.array_equal(a, b) for a, b in zip(mine.encode(data, offsets), first, strict=True))


def test_token_files(spark, make_docs, mixed_rows):
    ref = reference_tokenizer()
    docs = make_docs(mixed_rows)
    files = packing.write_segments(docs, packing.tokenizer_path(), segment_ids=500)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in packing.read_segments(files).collect()))
    assert files.count() > 5
    want, start = [], 0
    for i, t, _ in sorted(mixed_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*ref.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((start, i, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert packing.packed(docs.limit(0)).count() == 0


# --- chats ---------------------------------------------------------------------------------------


def brute_cost(codes):
    """Cheapest repair over all ways to give roles, merge, or put turns in."""
    best = math.inf
    for roles in itertools.product((1, 2, 3), repeat=len(codes)):
        cost = sum(chat.RELABEL for a, b in zip(roles, codes, strict=True) if a != b)
        for merges in itertools.product((False, True), repeat=len(codes)):
            state, total, legal = 0, cost, True
            for t, m in zip(roles, merges, strict=True):
                if m:
                    legal &= state == t
                    total += chat.MERGE
                elif t == 1:
                    legal &= state == 0
                else:
                    if t == 2 and state == 2 or t == 3 and state != 2:
                        total += chat.INSERT
                state = t
            total += {0: 0, 1: 2, 2: 1, 3: 0}[state] * chat.INSERT
            if legal:
                best = min(best, total)
    return best


def test_repair_is_cheapest():
    for n in range(5):
        for codes in itertools.product(range(4), repeat=n):
            assert chat.repair(list(codes))[0] == (brute_cost(codes) if codes else 0)


CHATS = "conv_id bigint, turn bigint, role string, text string, position bigint, cost bigint"


def chat_rows():
    r = random.Random(8)
    roles = ["user", "assistant", "system", "User ", "tool", None, "ASSISTANT"]
    rows = [(c, t, r.choice(roles), f"t{c}.{t} <|user|> é") for c in range(40) for t in range(r.randrange(1, 9))]
    rows += [(99, t, r.choice(roles[:2]), f"x{t}") for t in range(700)]
    rows += [(50, None, "user", "a"), (50, 1, "user", None), (50, 1, "user", None), (50, 1, "assistant", ""), (None, 3, "user", "n"), (None, 1, None, "m")]
    return rows


def code_of(role):
    role = (role or "").strip().lower()
    return chat.ROLES.index(role) + 1 if role in chat.ROLES else 0


@pytest.mark.parametrize("segment", [1024, 3])
def test_formatting(spark, segment):
    rows = chat_rows()
    turns = spark.createDataFrame([(*r, 1, 2) for r in rows], CHATS).repartition(4)
    got = chat.formatted(turns, segment=segment).collect()
    assert len(got) == len(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.position)
        assert Counter((r.turn, r.role) for r in mine) == Counter((t, o) for c, t, o, _ in rows if c == conv)
        cost, states = chat.repair([code_of(r.role) for r in mine])
        assert sum(r.cost for r in mine) == cost
        assert [r.new_role for r in mine] == [chat.ROLES[s - 1] for s in states[1:]]
        text = "".join(r.rendered for r in mine)
        blocks = re.findall(r"<\|(\w+)\|>\n(.*?)<\|end\|>\n", text, re.DOTALL)
        assert "".join(f"<|{a}|>\n{b}<|end|>\n" for a, b in blocks) == text
        order = [a for a, _ in blocks]
        order = order[1:] if order[:1] == ["system"] else order
        assert order == ["user", "assistant"] * (len(order) // 2)
    assert chat.formatted(turns.limit(0)).count() == 0


# --- URLs ----------------------------------------------------------------------------------------


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v, h + p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best and best[1]


URLS = [
    "http://a.com/x", "https://WWW.Example.com/en/1?q#f", "http://example.com/en/", "http://m.www.example.com/en/", "http://x.net/es/1", "http://net/fr/", "http://x.net/es", "ftp://com", "com/", None, "", "://", "http://com?x/", "x://y://z.com/p",
    "http://casinowin.org/en/1", "http://bigcasino.org/", "http://goodnews.org/en/casino", "http://É.com/É", "http://xcom/", "http://thenews.net/de/1", "http://a-b.co/" + "p" * 5000, "http://" + "n" * 400 + ".org/",
]


def brute_model(rows):
    """Host words and odds of each row's URL, by the definition."""
    texts = [re.sub("<[^>]*>", " ", h or "") for _, _, h in rows]
    counts = Counter(w for t in texts for w in re.findall("[a-z]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)))
    known, seen = [], {"block": Counter(), "allow": Counter()}
    examples = Counter()
    for _, u, _ in rows:
        host, path, _, verdict = brute_url(u)
        names = re.findall("[a-z]+", host[: host.rindex(".")] if "." in host else "")
        ws = [w for n in names for w in urls.segment(n, counts, sum(counts.values()))]
        tokens = ws + re.findall("[a-z0-9]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in path))
        known.append((ws, tokens))
        if verdict:
            examples[verdict] += 1
            seen[verdict].update(tokens)
    size = len(set(seen["block"]) | set(seen["allow"])) + 1
    chance = lambda t, v: (seen[v][t] + 1) / (sum(seen[v].values()) + size)
    prior = math.log((examples["block"] + 1) / (examples["allow"] + 1))
    return [(" ".join(ws), prior + sum(math.log(chance(t, "block") / chance(t, "allow")) for t in tokens)) for ws, tokens in known]


def test_urls(spark):
    giant = "w" * 30 + "news" + "z" * 41
    html = f"<p class='no'>the good news casino win big win the casino</p> good big A-b {giant} fr es"
    more = [f"http://shop{k}.net/{'es' if k % 2 else 'fr'}/sale/{k}" for k in range(6)] + ["http://x.org/es/sale", "http://y.org/about", f"http://the{giant}good.org/en/", "http://" + "goodnews" * 300 + ".org/"]
    rows = [(k, u, html if k % 2 else None) for k, u in enumerate(URLS + more)] + [(None, URLS[0], "x"), (1, URLS[1], "x")]
    pages = spark.createDataFrame([(*r, "h", "p", "r") for r in rows], "page_id bigint, url string, html string, host string, path string, rule string").repartition(3)
    got = urls.judged(pages).collect()
    assert len(got) == len(rows)
    model = {}
    for (_, u, _), (ws, odds) in zip(rows, brute_model(rows), strict=True):
        model[brute_url(u)[:2]] = (ws, odds)
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == Counter((i, *brute_url(u)[:3]) for i, u, _ in rows)
    for r in got:
        ws, odds = model[r.host, r.path]
        assert r.host_words == ws and r.odds / 1e6 == pytest.approx(odds, abs=1e-3 + 1e-5 * len(r.path))
        verdict = next((brute_url(u)[3] for i, u, _ in rows if i == r.page_id and brute_url(u)[:2] == (r.host, r.path)), None)
        assert r.verdict == (verdict or ("block" if r.odds > 0 else "allow"))
    by_host = {r.host: r for r in got}
    assert by_host["casinowin.org"].host_words == "casino win" and by_host["goodnews.org"].host_words == "good news"
    assert by_host[f"the{giant}good.org"].host_words == f"the {giant} good"
    assert by_host["x.org"].odds > by_host["y.org"].odds
    assert urls.judged(pages.limit(0)).count() == 0


def test_segmentation_is_the_best_split():
    counts = {"a": 3, "ab": 5, "b": 2, "ba": 4, "abc": 1, "c": 1}
    total = 16

    def score(words):
        return sum(math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10) for w in words)

    def splits(s):
        return [[]] if not s else [[s[:k], *rest] for k in range(1, len(s) + 1) for rest in splits(s[k:])]

    for n in range(1, 7):
        for name in map("".join, itertools.product("abc", repeat=n)):
            got = urls.segment(name, counts, total)
            assert "".join(got) == name and score(got) == pytest.approx(max(map(score, splits(name))))
    assert urls.segment("x" * 60, {}, 100) == ["x" * 60]


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir):
    """Each stage's rows follow from its operator on what the stage before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    kept = [ids]
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        docs = out.persist()
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert kept[1] == {r.doc_id for r in quality.judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect() if r.kept}
    assert kept[0] > kept[1] > kept[2] >= kept[3] and kept[3]
    mix = corpus_pipeline.source_mix(spark, docs, sf_dir).persist()
    assert mix.columns == docs.columns
    tokens = corpus_pipeline.token_files(spark, mix, sf_dir).collect()
    assert Counter(r.doc_id for r in tokens) == Counter(r.doc_id for r in mix.select("doc_id").collect())
    last = max(tokens, key=lambda r: r.start)
    assert last.start + last.n_tokens == sum(r.n_tokens for r in tokens)
