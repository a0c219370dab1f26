"""WARC archives and sharding."""

import hashlib
import struct
import zlib

import pytest
import zstandard

from cropframe.llm import sharding, warc

PAGES = "page_id long, url string, html string, digest string, first long"


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>é</p>" * 200_000
    rows = [(1, "http://a", "<html>" + "x" * 200, "d", 1), (2, "http://b\r\nX: y", "<html>" + "x" * 200, None, 2),
            (3, None, None, "d", 3), (4, "", "", "d", 4), (5, "u", "short", "d", 5), (6, "u", "short", "d", 6),
            (None, "n", "<html>" + "x" * 200, "d", 7), (7, "v", big, "d", 8), (8, "v", big, "d", 9),
            (9, "w", "a\r\n\r\nWARC/1.1\r\n" + "y" * 90, "d", 1), (2, "http://b", "<html>" + "x" * 200, None, 2)]
    rows += [(100 + i, "u", "z" * 150, "q", 0) for i in range(300)]
    return spark.createDataFrame(rows, PAGES)


def test_warc_round_trip(spark, pages, tmp):
    path = warc.write_archives(pages, f"{tmp}/archives")
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                  for r in warc.read_archives(spark, path).collect()), key=str)
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    want = []
    for page_id, body in rows:
        first = min((i for i, b in rows if b == body and i is not None), default=None)
        again = len(body) >= 100 and page_id is not None and page_id != first
        want.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response",
                     first if again else None))
    assert got == sorted(want, key=str)
    texts = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(spark, path).collect()
             if r["record_type"] == "response" and r["page_id"] is not None}
    assert texts[7] == "<p>é</p>" * 200_000 and texts[3] == ""


def test_archive_is_a_zstd_stream_with_a_leading_dictionary(spark, pages, tmp):
    path = warc.write_archives(pages.coalesce(1), f"{tmp}/one")
    files = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).collect()]
    for data in files:
        magic, size = struct.unpack_from("<II", data)
        assert magic == 0x184D2A5D
        raw = zstandard.ZstdDecompressor().decompress(data[8:8 + size], max_output_size=1 << 20)
        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        records = [d.decompress(b) for m, b in warc.split_frames(data) if m == warc.ZSTD_MAGIC]
        assert all(r.startswith(b"WARC/1.1\r\n") for r in records)


def test_broken_archives_are_refused():
    raw = warc.record_bytes(5, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "2024-01-01T00:00:00Z")
    assert warc.parse_record(raw)["payload"] == b"payload"
    frame, d = warc.dictionary_frame([raw])
    c = zstandard.ZstdCompressor(dict_data=d, write_checksum=True)
    whole = frame + c.compress(raw)
    assert [r["page_id"] for r in warc.read_archive(whole)] == [5]
    bad = [raw.replace(b"payload\r\n", b"pay\r\n"), raw.replace(b"WARC/1.1", b"WARC/0.1"), raw[:-1],
           raw.replace(b"Content-Length: 7", b"Content-Length: 9"), raw.replace(b"WARC-Type", b"X"), raw + b"x",
           raw.replace(b"payload", b"PAYLOAD")]
    for b in bad:
        with pytest.raises(warc.ArchiveError):
            list(warc.read_archive(frame + c.compress(b)))
    for cut in (whole[:-3], whole[:len(frame) + 2], whole + b"\0\0\0", whole[:6]):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_archive(cut))
    with pytest.raises(warc.ArchiveError):
        list(warc.read_archive(frame + c.compress(raw + raw)))


def test_no_pages(spark, pages, tmp):
    path = warc.write_archives(pages.limit(0), f"{tmp}/none")
    assert warc.read_archives(spark, path).count() == 0


def test_shards_are_near_equal_and_places_gapless(odd_docs):
    got = sharding.shard_by_bytes(odd_docs, shards=4, slots=64).collect()
    rows = odd_docs.collect()
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted(
        (len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows)
    for s in {r["shard"] for r in got}:
        places = sorted(r["slot"] for r in got if r["shard"] == s)
        assert places == list(range(len(places)))


def test_even_slots_give_even_shards():
    weights = [(k * 7919) % 1000 + 500 for k in range(4096)]
    mapping = sharding.balanced_map(weights, 16)
    loads = [sum(w for w, s in zip(weights, mapping, strict=True) if s == k) for k in range(16)]
    assert max(loads) <= 1.001 * sum(loads) / 16


def test_rebalance_moves_little():
    weights = [(k * 7919) % 1000 + 500 for k in range(4096)]
    mapping = sharding.balanced_map(weights, 16)
    grown = sharding.rebalance(mapping, weights, 17)
    moved = [k for k in range(4096) if grown[k] != mapping[k]]
    assert all(grown[k] == 16 for k in moved) and len(moved) < 4096 / 17 * 1.2
    loads = [sum(w for w, s in zip(weights, grown, strict=True) if s == k) for k in range(17)]
    assert max(loads) <= 1.03 * sum(loads) / 17
    heavier = [w * 5 if s == 3 else w for w, s in zip(weights, mapping, strict=True)]
    edited = sharding.rebalance(mapping, heavier, 16)
    assert all(mapping[k] == 3 for k in range(4096) if edited[k] != mapping[k])


def test_map_versions(spark, tmp):
    path = sharding.store_map(spark, [0, 1, 1, 0], 1, f"{tmp}/map")
    sharding.store_map(spark, [0, 1, 2, 0], 2, path)
    assert sharding.load_map(spark, path, 1) == [0, 1, 1, 0]
    assert sharding.load_map(spark, path) == [0, 1, 2, 0]


def test_a_second_run_edits_the_stored_map(spark, tmp):
    """The shard of every row is the stored map's entry of its slot; a grown table moves only slots that the edit names."""
    rows = [(i, "x" * (i * 37 % 90)) for i in range(3000)]
    path, kinds = f"{tmp}/slots", "doc_id long, text string"
    first = {r["doc_id"]: r for r in sharding.shard_by_bytes(
        spark.createDataFrame(rows, kinds), 4, 64, map_path=path).collect()}
    old = sharding.load_map(spark, path, 1)
    assert all(r["shard"] == old[r["vslot"]] for r in first.values())
    heavy = [r["doc_id"] for r in first.values() if r["shard"] == 2]
    grown = spark.createDataFrame(rows + [(5000 + i, "y" * 400) for i in range(40)], kinds)
    second = {r["doc_id"]: r for r in sharding.shard_by_bytes(grown, 4, 64, map_path=path).collect()}
    new = sharding.load_map(spark, path)
    weights = [0] * 64
    for r in second.values():
        weights[r["vslot"]] += r["size"]
    assert new == sharding.rebalance(old, weights, 4) and new != old and heavy
    for k, r in first.items():
        assert second[k]["vslot"] == r["vslot"]
        assert (second[k]["shard"] != r["shard"]) == (new[r["vslot"]] != old[r["vslot"]])
    assert all(r["shard"] == new[r["vslot"]] for r in second.values())
    with pytest.raises(ValueError):
        sharding.shard_by_bytes(grown, 4, 128, map_path=path)


def test_sharding_plan_is_native(odd_docs, no_docs):
    plan = sharding.shard_by_bytes(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert sharding.shard_by_bytes(no_docs).count() == 0
