import gzip
import hashlib
import random
from collections import defaultdict

import pytest

from lectern.llm import warc


def expected(rows):
    groups = defaultdict(list)
    body = [(h or "").encode() for _, _, h in rows]
    for (p, _, _), b in zip(rows, body):
        if len(b) >= 1000:
            groups[b].append(-1 if p is None else p)
    out = []
    for (p, _, _), b in zip(rows, body):
        top = max(groups.get(b, [-1]))
        revisit = len(b) >= 1000 and top != -1 and p != top
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, monkeypatch):
    rng = random.Random(1)
    page = lambda n: "<p>" + "".join(rng.choice("abc é\r\n\r\n") for _ in range(n)) + "</p>"
    bodies = [page(n) for n in (10, 990, 1500, 3000)]
    rows = [(i, f"http://x/{i}", rng.choice([*bodies, page(rng.randint(0, 4000))])) for i in range(300)]
    rows += [(900, None, None), (901, "u\r\nX: y", ""), (None, "n", bodies[2]), (None, "n", page(5000)), (5, "again", rows[5][2]), (902, "big", "z" * 3_000_000), (903, "é", "z" * 1000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, n int, digest string").repartition(5)
    index = warc.write(df)
    got = warc.read(index).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    have = {(r.page_id, r.payload_digest): bytes(r.payload) for r in got if r.record_type == "response"}
    for p, _, h in rows:
        b = (h or "").encode()
        assert have.get((p, hashlib.sha1(b).hexdigest()), b) == b
    place = index.where("page_id = 902").first()
    with open(place.file.removeprefix("file:"), "rb") as f:
        f.seek(place.offset)
        assert gzip.decompress(f.read(place.length)).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    # ranges: a selection with gaps, small reads, small cells
    monkeypatch.setattr(warc, "READ", 2000)
    monkeypatch.setattr(warc, "GAP", 300)
    monkeypatch.setattr(warc, "CELL", 5000)
    some = warc.read(index.where("page_id % 7 = 0"), payloads=False).collect()
    assert sorted(r.page_id for r in some) == sorted(p for p, _, _ in rows if p is not None and p % 7 == 0) and all(r.payload is None for r in some)
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_damage_is_found():
    good = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, "2024-01-01T00:00:00Z")
    assert warc.parse(good)["payload"] == b"payload"
    for bad in (good.replace(b"payload\r\n", b"paylord\r\n"), good[:-5], b"x" + good):
        with pytest.raises(ValueError):
            warc.parse(bad)
