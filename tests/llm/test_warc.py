import gzip
import io

import pytest

from datakiln.llm import warc


def _file(n=5):
    return [warc.record_bytes(f"urn:page:{i}:0", "http://x/" + "é" * i, (f"page {i} " * 10_000 * i).encode()) for i in range(n)]


def test_reader_round_trip():
    got = list(warc.read_records(io.BytesIO(b"".join(_file()))))
    assert [r.payload for r in got] == [(f"page {i} " * 10_000 * i).encode() for i in range(5)]
    assert all(gzip.decompress(m).startswith(b"WARC/1.1\r\n") for m in _file())


def test_small_reads():
    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 7) if n > 0 else n)

    assert len(list(warc.read_records(Slow(b"".join(_file(3))), keep_payload=False))) == 3


def test_damage():
    whole = b"".join(_file(3))
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_records(io.BytesIO(whole[:-9])))
    text = gzip.decompress(_file(2)[1])
    for bad, why in (
        (text.replace(b"page 1 ", b"page 2 ", 1), "digest"),
        (text[:-5], "shorter|end"),
        (text + b"more", "more than"),
        (text.replace(b"\r\n\r\n", b"\r\n\r\nx", 1), "longer|digest"),
    ):
        with pytest.raises(ValueError, match=why):
            list(warc.read_records(io.BytesIO(gzip.compress(bad))))
