"""Operators must find what lies anywhere, by truth that isn't made with their own cuts."""

import random
import zlib

import numpy as np

from storelens.llm import decontam, packing, secrets

KEY = "Zk3x9QpLm2Vt8RbYw5HsJd7FgNc4TaXe6UiOz1K0"


def test_secrets_in_env_lines_query_strings_and_paths(make_docs):
    texts = [f"AWS_ACCESS_KEY={KEY} end", f"http://a.example/x?sig={KEY}==&b=1", f"dir/x_y+z={KEY}", f"lib/a/{KEY}-v", f"k-{KEY}=t=u", f"é {KEY}"]
    got = {r.doc_id: r.spans for r in secrets.secrets(make_docs([(i, t, "a") for i, t in enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        at = text.index(KEY)
        spans = [tuple(map(int, s.split(":")[1:])) for s in got[i].split(",") if s.startswith("random:")]
        assert any(a <= at and at + len(KEY) <= b for a, b in spans), text


def test_pieces_are_maximal():
    r = random.Random(3)
    fits = lambda x: "=" not in x and not ({*x} & {*"+/"} and {*x} & {*"-_"})
    for _ in range(300):
        run = "".join(r.choice("aB1" * 12 + "=+/-_") for _ in range(r.randrange(20, 120)))
        body = len(run.rstrip("="))
        ok = [(a, b) for a in range(body) for b in range(a + 20, body + 1) if fits(run[a:b])]
        want = [(a, b) for a, b in ok if (a == 0 or not fits(run[a - 1 : b])) and (b == body or not fits(run[a : b + 1]))]
        got = secrets.pieces(run.encode())
        assert [(a, min(b, body)) for a, b in got] == want or (fits(run[:body]) and got == [(0, len(run))])


def test_part_leaks_are_found_wherever_they_begin(spark, make_docs, prose):
    items = [(k, " ".join(prose(50, 900 + k, 5000))) for k in range(6)] + [(10 + k, " ".join(prose(14 + k, 950 + k, 5000))) for k in range(9)] + [(30, "ab cd")]
    words = {i: t.split() for i, t in items}
    r, docs, want = random.Random(8), [], set()

    def add(item, part):
        around = [prose(40, len(docs) + 5000, 5000), prose(40, len(docs) + 7000, 5000)]
        docs.append((len(docs), " ".join([*around[0], *part, *around[1]]), "a"))
        want.add((len(docs) - 1, item))

    for item in range(6):
        for n in (12, 16, 20, 24, 28, 32):
            at = r.randrange(51 - n)
            add(item, words[item][at : at + n])
    for item in [*range(10, 19), 0, 1, 2]:
        for _ in range(3):
            part = list(words[item])[:25]
            part[r.randrange(len(part))] = "replacement"
            add(item, part)
    add(30, ["ab", "cd"])
    docs.append((len(docs), "xab cd ab cde " + " ".join(prose(60, 1, 5000)), "a"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert {(x.doc_id, x.item_id) for x in decontam.leaks(make_docs(docs), bench).collect()} == want
    assert [x.doc_id for x in decontam.without_leaks(make_docs(docs), bench).collect()] == [len(docs) - 1]


def test_token_ids_of_special_tokens_are_the_librarys(make_docs):
    from tokenizers import Tokenizer

    r, ref = random.Random(6), Tokenizer.from_file(packing.tokenizer_path())
    parts = ["a", "bc", "é", " ", "  ", "\n", ".", "'s", "foo", "<|endoftext|>", "漢"]
    texts = ["a <|endoftext|> b<|endoftext|>"] + ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(2000)]
    got = {x.doc_id: (x.n_tokens, x.ids_crc32) for x in packing.packed(make_docs([(i, t, "a") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        ids = np.array([*ref.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes())), t
