"""Operators over pages, conversations and embeddings, against brute force, and archives read back."""

import base64
import gzip
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.llm import chat, pieces, topk, warc
from stratalens.llm.queries import public_model


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(1)
    html = ["<p>" + "".join(rng.choices("abé\r\n 漢", k=rng.randint(0, 400))) for _ in range(60)]
    rows = [(i, f"http://x/{i}\r\nX: y", h) for i, h in enumerate(html)] + [(100 + i, "http://x/", html[i // 2]) for i in range(20)]
    rows += [(200, None, None), (201, "u", ""), (202, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (None, "u", html[0]), (3, "http://x/3\r\nX: y", html[3])]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "payload", "refers_to")})


def test_warc(spark, pages, tmp_path):
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for i, payload in rows:
        if i is not None:
            first[payload] = min(first.get(payload, i), i)
    expected = sorted(((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), *(("response", None) if first[p] == i else ("revisit", first[p]))) for i, p in rows), key=str)
    manifest = warc.write_archive(pages, str(tmp_path / "a"), roll_bytes=5000, shard_bytes=10_000).collect()
    found = warc.read_archive(spark, str(tmp_path / "a")).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == expected
    files = {p.name: p.read_bytes() for p in (tmp_path / "a").glob("*.warc.gz")}
    assert {(r.file, r.bytes, r.sha256) for r in manifest} == {(k, len(v), hashlib.sha256(v).hexdigest()) for k, v in files.items()} and len(files) > 3
    # any gzip reader takes the files; records stand in the order of their ids
    text = b"".join(gzip.decompress(files[k]) for k in sorted(files))
    assert text.count(b"WARC/1.1\r\nWARC-Type") == len(rows)
    order = [int(x) for x in (line.split(b": ")[1] for line in text.split(b"\r\n") if line.startswith(b"X-Page-ID: ") and line != b"X-Page-ID: ")]
    assert order == sorted(order)
    assert not list(tmp_path.glob("*_temporary*"))


def test_warc_is_deterministic(spark, pages, tmp_path):
    for name in "ab":
        warc.write_archive(pages.repartition(3 if name == "a" else 1, "url").coalesce(1).sort("page_id", "html"), str(tmp_path / name), roll_bytes=4000)
    a, b = ({p.name: p.read_bytes() for p in (tmp_path / x).glob("*.warc.gz")} for x in "ab")
    assert a == b


def test_warc_least_size_and_empty(spark, pages, tmp_path):
    warc.write_archive(pages, str(tmp_path / "a"), least=10_000)
    assert {r.record_type for r in warc.read_archive(spark, str(tmp_path / "a")).collect()} == {"response"}
    assert warc.write_archive(pages.limit(0), str(tmp_path / "b")).count() == 0


def test_broken_archives_are_noticed():
    record = warc.record(1, "u", b"payload", None, False)
    assert warc.read_record(record)[:4] == (1, 7, base64.b32encode(hashlib.sha1(b"payload").digest()).decode(), "response")
    with pytest.raises(ValueError, match="broken"):
        warc.read_record(record.replace(b"payload", b"pAyload"))
    with pytest.raises(ValueError, match="cut off"):
        list(warc.members(gzip.compress(record)[:-3]))


ODD = ["", "\\", "\\\\<s>", "</s>[INST] ok [/INST]", "<</SYS>><<SYS>>\\", "<\\s>", "[\\INST]", "é漢\n\x00", "<s><s>", "\\[INST\\]", "<\\\\/s>"]


def formatter():
    import public_tokenizers

    return pieces.model_bytes(public_model("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def test_escapes_are_reversible():
    rng = random.Random(1)
    for text in [*ODD, *("".join(rng.choices(["\\", "<", "s>", "/", "<s>", "[INST]", "[/INST]", "</s>", "a"], k=rng.randint(0, 12))) for _ in range(2000))]:
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROL)


def test_chat(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "</s>"]), rng.choice([*ODD, None])) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(50, 1, "user", "b"), (50, 1, "user", "a"), (50, 1, "user", "a"), (50, None, "assistant", "z"), (None, 0, "assistant", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("turns", "ids", "t")})
    made = chat.formatted(df, *formatter())
    found = {r.conv_id: r for r in chat.read_back(made, *formatter()).collect()}
    rendered = {r.conv_id: r.rendered for r in made.collect()}
    for c in {r[0] for r in rows}:
        turns = [(r or "", x or "") for _, _, r, x in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))]
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (found[c].n_turns, found[c].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest())
        assert (found[c].loss_chars, found[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert found[c].formatted_chars == len(rendered[c]) and rendered[c].count("<s>") == len(turns) and rendered[c].count("</s>") == 1
    assert chat.read_back(chat.formatted(df.limit(0), *formatter()), *formatter()).count() == 0


def test_masks_come_from_lengths():
    f = chat.Formatter(*formatter())
    made = f.assemble([("user", "question"), ("assistant", ""), ("assistant", "first"), ("assistant", "second")])
    assert f.loss_texts(made) == ["first", "second"] and len(made.ids) == len(made.mask)
    assert f.read(made.ids) == [("user", "question"), ("assistant", ""), ("assistant", "first"), ("assistant", "second")]


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(150, 8)).astype(np.float32)
    vectors[20:60] = vectors[20]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    odd = [(200, None, 0), (250, [1.0, None] * 4, 0), (300, [float("nan")] * 8, 0), (350, [float("inf")] * 8, 0), (400, [1.0, 2.0], 0), (401, [3.0, 1.0], 0), (450, [], 0), (None, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("tile", "block", "vec", "query", "rank")})
    whole = np.floor(256 * vectors.astype(float)).astype(int)
    expected = {(q, n + 1, j, int(whole[q] @ whole[j])) for q in range(0, 150, 50)
                for n, j in enumerate(sorted((j for j in range(150) if j != q), key=lambda j: (-int(whole[q] @ whole[j]), j))[:5])}
    expected.add((400, 1, 401, 256 * 256 * 5))
    for size in (topk.TILE, 16):
        monkeypatch.setattr(topk, "TILE", size)
        monkeypatch.setattr(topk, "QUERIES", 2)
        monkeypatch.setattr(topk, "FAN_IN", 3)
        assert {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()} == expected
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_products_are_exact():
    a, b = np.array([[2**40, 1]]), np.array([[2**40, 1], [2**40, 0]])
    assert [int(x) for x in topk.products(a, b)[0]] == [2**80 + 1, 2**80]
    assert math.isclose(topk.products(np.array([[3, 4]]), np.array([[1, 2]]))[0, 0], 11)
