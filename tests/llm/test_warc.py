import base64
import gzip
import hashlib
import random

from pyspark.sql import functions as F

from presswork.llm import warc
from presswork.llm.common import new_path
from tests.llm.helpers import ODD, prose


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def corpus():
    rng = random.Random(4)
    rows = [(k, f"http://h/{k}", rng.choice(["same", "twice", prose(rng, 50)])) for k in range(60)]
    rows += [(100 + k, None, t) for k, t in enumerate(ODD)] + [(120, "u\r\nWARC/1.1 \n", "WARC/1.1\r\n\r\n\x1f\x8b\x08"), (None, "u", "same"), (None, "u", "only null id"), (121, "big", "x" * 300_000)]
    return [*rows, rows[3]]


def model(rows, least=0):
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(top.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        t = top.get(h or "") if len(b) >= least else None
        again = t is not None and i != t
        out.append((i, len(b), digest(b), "revisit" if again else "response", t if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string")
    for least in (0, 10):
        path = new_path(spark, "warc")
        warc.write_archive(df, path, least)
        got = warc.read_archive(spark, path)
        assert got.where("gap is not null").count() == 0
        have = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["warc_type"], r["refers_to"]) for r in got.collect()]
        assert sorted(have, key=str) == model(rows, least)
        first = got.where("warc_type = 'response'").collect()
        assert all(digest(r["payload"]) == r["payload_digest"] for r in first)
    data = spark.read.format("binaryFile").load(path).select("content").collect()
    for r in data:
        plain = gzip.decompress(bytes(r["content"]))
        assert plain == b"" or plain.startswith(b"WARC/1.1\r\n")


def test_salvage():
    """A damaged member is quarantined; the records on both sides survive."""
    rng = random.Random(7)
    made = [warc.member(warc.record("response", k, None, p, digest(p), len(p), None)) for k, p in enumerate(prose(rng, 200).encode() for _ in range(5))]
    sep = warc.EMPTY_MEMBER
    whole = sep.join(made) + sep
    assert [r["page_id"] for r in warc.salvage(whole)] == list(range(5))
    broken = bytearray(whole)
    at = len(made[0]) + 20
    for k in range(at + 30, at + 60):
        broken[k] ^= 0xFF
    got = list(warc.salvage(bytes(broken)))
    assert [r["page_id"] for r in got if not r["gap"]] == [0, 2, 3, 4]
    gap, = (r for r in got if r["gap"])
    assert gap["at"] == at and gap["n_bytes"] == len(made[1])
    cut = list(warc.salvage(whole[: len(whole) - 60]))
    assert [r["page_id"] for r in cut if not r["gap"]] == [0, 1, 2, 3] and cut[-1]["gap"]
    assert [bool(r["gap"]) for r in warc.salvage(b"junk bytes" + whole)] == [True] + [False] * 5
    plain = b"".join(warc.record("response", k, None, b"p%d" % k, digest(b"p%d" % k), 2, None) for k in range(3))
    assert [r["page_id"] for r in warc.salvage(plain)] == [0, 1, 2]
    bad = plain.replace(b"p1", b"p9")
    assert [(r.get("page_id"), bool(r["gap"])) for r in warc.salvage(bad)] == [(0, False), (None, True), (2, False)]
    assert list(warc.salvage(b"")) == []


def test_empty(spark):
    path = new_path(spark, "warc")
    warc.write_archive(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.read_archive(spark, path).where(F.col("gap").isNull()).collect() == []


def test_salvage_inside_members():
    """Of a member with several records, only the damaged ones are lost."""
    rng = random.Random(8)
    texts = [prose(rng, 3000).encode() for _ in range(6)]
    made = [warc.record("response", k, None, p, digest(p), len(p), None) for k, p in enumerate(texts)]
    after = warc.member(warc.record("response", 9, None, b"z", digest(b"z"), 1, None))

    def seen(data):
        return [r["gap"] and "gap" or r["page_id"] for r in warc.salvage(data)]

    one = warc.member(b"".join(made))
    assert seen(one + after) == [0, 1, 2, 3, 4, 5, 9]
    digest_off = made[2].replace(texts[2][:9], b"#########")
    length_off = made[3].replace(b"Content-Length: ", b"Content-Length: 9")
    assert seen(warc.member(b"".join([*made[:2], digest_off, *made[3:]])) + after) == [0, 1, "gap", 3, 4, 5, 9]
    assert seen(warc.member(b"".join([*made[:2], digest_off, length_off, *made[4:]])) + after) == [0, 1, "gap", 4, 5, 9]
    assert seen(warc.member(b"junk" + b"".join(made))) == ["gap", 0, 1, 2, 3, 4, 5]
    # Cut off, a bad checksum, and damage in the middle; each also behind junk.
    cut, crc, hurt = one[: len(one) * 4 // 5], bytearray(one), bytearray(one)
    crc[-8] ^= 1
    hurt[len(one) // 2 : len(one) // 2 + 40] = bytes(40)
    for junk, gap in ((b"", []), (b"some junk", ["gap"])):
        assert seen(junk + cut) == [*gap, 0, 1, 2, 3, "gap"]
        assert seen(junk + bytes(crc) + after) == [*gap, 0, 1, 2, 3, 4, 5, "gap", 9]
        got = seen(junk + bytes(hurt) + after)
        assert got[: len(gap) + 2] == [*gap, 0, 1] and got[-2:] == ["gap", 9]
