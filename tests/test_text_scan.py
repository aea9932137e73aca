"""The text scan: blocks of any size give the same lines, slices read only their blocks."""

import io

import numpy as np
import pytest

from pulseforge.sources import recordings as rc
from pulseforge.sources import text_scan as ts


@pytest.mark.parametrize("text", [b"", b"\n", b"a", b"a\n", b"ab\n\ncd\ne", b"ab\n\n\n", b"long line without end" * 3, b"x\ny\nzz\n"])
@pytest.mark.parametrize("piece", [1, 2, 5, 1000])
def test_blocks_of_any_size_partition_the_lines(text, piece, monkeypatch):
    monkeypatch.setattr(ts, "PIECE", piece)
    want = text.split(b"\n")[: -1 if text.endswith(b"\n") else None] if text else []
    for size in range(1, len(text) + 2):
        cuts = [(lo, min(lo + size, len(text))) for lo in range(0, len(text), size)]
        parts = [[x for some in ts.lines_of(io.BytesIO(text), lo, hi) for x in some] for lo, hi in cuts]
        assert [x for p in parts for x in p] == want
        assert [len(p) for p in parts] == [ts.line_starts(io.BytesIO(text), lo, hi) for lo, hi in cuts]


def test_slices_read_only_their_blocks(spark, tmp_path):
    rng = np.random.default_rng(0)
    paths = []
    for k, ms in enumerate(("0.5 ms/sample", "no rate")):
        head = [f"h{i} é" for i in range(13)] + [ms]
        body = [f"{i},{v:.4f},{i * 2},{'bad' if i % 50 == 7 else -i}" for i, v in enumerate(rng.normal(size=3000))]
        body[100] = "no comma"
        body[101] = ""
        paths.append(tmp_path / f"r{k}.txt")
        paths[k].write_bytes("\r\n".join(head + body).encode("latin1"))
    index = ts.line_index(spark, f"{tmp_path}/r*.txt", block=4000)
    assert len(index) > 20 and {b["fs"] for b in index} == {2000.0, 10_000.0} and sum(b["n"] for b in index) == 2 * 3014
    whole = rc.read_recordings(spark, f"{tmp_path}/r*.txt", index=index)
    rows = whole.collect()
    assert len(rows) == 2 * 2998 and whole.columns == ["file", "sample_idx", "fs", "CH1", "CH40", "CH41"]
    assert all(r.CH40 == 2.0 * r.sample_idx and r.CH41 == (0.0 if r.sample_idx % 50 == 7 else -r.sample_idx) for r in rows)
    again = {(r.file, r.sample_idx): r.CH1 for r in rc.read_recordings(spark, str(tmp_path)).collect()}
    assert again == {(r.file, r.sample_idx): r.CH1 for r in rows}
    # a slice of one file: a few partitions, and the other blocks may hold anything by now
    own = [b for b in index if b["file"].endswith("r0.txt")]
    part = rc.read_recordings(spark, "", ["CH40"], start=0.5, duration=0.1, delay=0.25, index=own)
    need = ts.chosen(own, 0.5, 0.1, 0.25)
    assert 0 < len(need) <= 3 and part.rdd.getNumPartitions() == len(need)
    data = bytearray(paths[0].read_bytes())
    lo, hi = need[0]["lo"] - 1, need[-1]["hi"] + 200
    data[:lo], data[hi:] = b"#" * lo, b"#" * (len(data) - hi)
    paths[0].write_bytes(bytes(data))
    assert sorted((r.sample_idx, r.CH40) for r in part.collect()) == [(i, 2.0 * (1500 + i)) for i in range(200)]


def test_empty_and_odd_paths(spark, tmp_path):
    (tmp_path / "e.txt").write_bytes(b"")
    assert rc.read_recordings(spark, f"{tmp_path}/e.txt").count() == 0
    assert rc.read_recordings(spark, f"{tmp_path}/none*.txt").count() == 0
    (tmp_path / "h.txt").write_bytes(b"only\na\nheader")
    assert rc.read_recordings(spark, f"{tmp_path}/h.txt").count() == 0
    with pytest.raises(ValueError):
        rc.read_recordings(spark, f"{tmp_path}/h.txt", ["CH9"])
