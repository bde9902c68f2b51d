"""The salvage reader against brute force over random damage, and its time."""

import gzip
import random
import zlib

import pytest

from memlake.llm import warc


def _records(n, rng, size=200):
    return [warc.record(i, f"u{i}", bytes(rng.randrange(256) for _ in range(rng.randrange(1, size))), None) + warc.END for i in range(n)]


def _ids(found):
    return [int(h["warc-record-id"].removeprefix("<urn:page:").rstrip(">")) for h, _, _ in found]


@pytest.mark.parametrize("seed", range(20))
def test_random_damage(seed):
    """All records whose bytes are whole come back, in order, and every other byte is in a gap."""
    rng = random.Random(seed)
    recs = _records(30, rng)
    data, starts = bytearray(b"".join(recs)), [sum(map(len, recs[:i])) for i in range(31)]
    hit = set()
    for _ in range(5):
        p = rng.randrange(len(data))
        data[p] ^= 1 << rng.randrange(8)
        hit.add(next(i for i in range(30) if p < starts[i + 1]))
    found, gaps = warc.salvage(bytes(data))
    sound = [i for i in range(30) if i not in hit]
    got = _ids([x for x in found if x[2] in starts and starts.index(x[2]) in sound])
    assert got == sound
    covered = sorted([*gaps, *((at, at + len(recs[starts.index(at)])) for _, _, at in found if at in starts)])
    assert covered[0][0] == 0 and covered[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False))


def test_bad_record_in_a_member():
    rng = random.Random(3)
    recs = [bytearray(x) for x in _records(50, rng)]
    recs[20][-10] ^= 1
    data = gzip.compress(b"".join(recs[:50])) + gzip.compress(bytes(recs[0]))
    found, gaps = warc.salvage(data)
    assert _ids(found) == [i for i in range(50) if i != 20] + [0]
    first = sum(map(len, recs[:20]))
    assert len(gaps) == 1 and gaps[0][0] == 0 and gaps[0].inner == ((first, first + len(recs[20])),)


@pytest.mark.parametrize("damage", ["cut", "flip"])
def test_broken_member(damage):
    """What stands before the break comes back, and all that follows the member."""
    rng = random.Random(4)
    recs = _records(400, rng, 900)
    whole, tail = b"".join(recs), gzip.compress(recs[7])
    member = bytearray(gzip.compress(whole))
    at = len(member) * 2 // 3
    if damage == "cut":
        del member[at:]
        plain = zlib.decompressobj(31).decompress(bytes(member))
    else:
        member[at] ^= 0x55
        plain = b""
    found, gaps = warc.salvage(bytes(member) + tail)
    got = _ids(found)
    before = list(range(len(got) - 1))  # a flipped byte in a stored block harms one record, the member's checksum fails only at its end
    assert got[-1] == 7 and len(got) > 200 and (got[:-1] == before if damage == "cut" else len({*range(400)} - {*got[:-1]}) <= 2 and got[:-1] == sorted(got[:-1]))
    if damage == "cut":
        ends = [sum(map(len, recs[: i + 1])) for i in range(400)]
        assert len(got) - 1 >= sum(e < len(plain) for e in ends) - 1
    assert gaps and gaps[0][0] == 0 and gaps[-1][1] == len(member)


def _looked_at(monkeypatch, data):
    """Bytes that searches go over and records take while `data` is read."""
    seen = []

    class Counted(warc._Next):
        def after(self, at):
            before = self.at
            found = super().after(at)
            if before <= at:
                seen.append(found - at)
            return found

    real = warc._record

    def record(data, at, stop):
        out = real(data, at, stop)
        seen.append((out if isinstance(out, int) else out[2]) - at)
        return out

    with monkeypatch.context() as m:
        m.setattr(warc, "_Next", Counted)
        m.setattr(warc, "_record", record)
        found, gaps = warc.salvage(data)
    assert not found and gaps == [(0, len(data))]
    return sum(seen)


@pytest.mark.parametrize("unit", [b"WARC/1.1\r\n junk ", b"WARC/1.1\r\n", b"x: WARC/1.1\r\n", b"WARC/1.1\r\na: b\r\n\r\n", b"WARC/1.1\r\nx: WARC/1.1\r\nContent-Length: 9\r\n", b"\x1f\x8b\x08\x00"])
def test_work_is_linear(monkeypatch, unit):
    """Twice the noise is twice the work, with and without the end of a header behind it."""
    for end in (b"", b"\r\n\r\nzz"):
        small, large = (_looked_at(monkeypatch, unit * n + end) for n in (2000, 4000))
        assert large <= 2.2 * small + 1000 and large <= 8 * len(unit) * 4000 + 1000


def test_members_with_bad_trailers():
    """Each record is there by its own digest, each member is a gap of its own; a revisit has no digest to vouch for it."""
    members = [bytearray(gzip.compress(warc.record(i, "u", b"x" * (100 + i), None) + warc.END)) for i in range(1000)]
    for m in members:
        m[-6] ^= 0x55
    found, gaps = warc.salvage(b"".join(members))
    starts = [sum(map(len, members[:i])) for i in range(1001)]
    assert _ids(found) == list(range(1000)) and list(map(tuple, gaps)) == list(zip(starts, starts[1:], strict=False))
    revisit = bytearray(gzip.compress(warc.record(7, "u", b"y", 3) + warc.END))
    revisit[-6] ^= 0x55
    assert warc.salvage(bytes(revisit)) == ([], [(0, len(revisit))])


def test_no_pages(spark, make, tmp_path):
    d = make()
    warc.write(spark.read.parquet(f"{d}/pages.parquet"), f"{tmp_path}/none")
    assert warc.read(spark, f"{tmp_path}/none").count() == 0 and warc.query(spark, d).count() == 0


def test_damaged_copy(spark, make, tmp_path):
    """Archives as written, then a damaged copy read beside a log of its gaps."""
    rng = random.Random(5)
    pages = [(i, f"u{i}", "page %d " % i + "y" * rng.randrange(100, 3000 if i % 50 else 200_000)) for i in range(600)]
    d = make(pages=pages)
    warc.write(spark.read.parquet(f"{d}/pages.parquet"), f"{tmp_path}/a")
    files = sorted((tmp_path / "a").rglob("part-*"))
    assert len(files) > 1 and all(f.stat().st_size <= warc.ARCHIVE_BYTES for f in files)
    for f in files:
        data = bytearray(f.read_bytes())
        (f.parent / f".{f.name}.crc").unlink()
        if f.parent.name == "size0":
            data[len(data) // 2] ^= 1
        f.write_bytes(gzip.compress(bytes(data)) if f.parent.name == "size1" else bytes(data))
    got = warc.log_gaps(warc.read(spark, f"{tmp_path}/a", "part-*"), f"{tmp_path}/gaps").collect()
    gaps = spark.read.parquet(f"{tmp_path}/gaps").collect()
    damaged = sum(f.parent.name == "size0" for f in files)
    assert len(gaps) == damaged and 600 - damaged <= len(got) < 600
    want = {i: (len(h.encode()), warc.digest(h.encode())) for i, _, h in pages}
    assert all((r["payload_bytes"], r["payload_digest"]) == want[r["page_id"]] for r in got)
